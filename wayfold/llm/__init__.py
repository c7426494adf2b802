"""Operators for corpora of texts. Nothing else in the library imports this subpackage."""
