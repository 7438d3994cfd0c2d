"""Spark-first analytics over purchase records and documents."""
