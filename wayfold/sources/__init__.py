"""Readers and writers for the text formats the tables come from and go to."""
