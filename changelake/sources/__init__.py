"""Readers: change feed, catalog rows, file listings."""
