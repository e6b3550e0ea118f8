"""Spark-first analytics over code and document corpora and agent sessions."""
