"""Docketry: analytics over administrative filing records, as Spark jobs."""
