"""Tender analytics as Spark DataFrame pipelines."""
