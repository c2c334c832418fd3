"""Incremental arrival of release files."""
