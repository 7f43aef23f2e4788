"""Tidemark: conflict-free replicated tables as Spark DataFrame aggregations."""
