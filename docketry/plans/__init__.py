"""Whole flows: case tables, read queries, publication, the driver's query registry."""
