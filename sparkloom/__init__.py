"""Spark-first corpus and code intelligence engine."""
