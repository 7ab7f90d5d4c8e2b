"""Spark-first analytics over event-rich case records."""
