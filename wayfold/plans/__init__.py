"""Composite pipelines and the query catalogue."""
