"""Spark jobs for field-level agricultural analytics."""
