"""Spark-first hybrid search and corpus-processing engine."""
