"""Spark-first corpus retrieval and evidence analytics."""
