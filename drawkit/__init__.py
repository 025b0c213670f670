"""Spark jobs over libraries of engineering drawings."""
