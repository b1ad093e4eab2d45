"""Bulk evidence-retrieval analytics as PySpark DataFrame operators."""
