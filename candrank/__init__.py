"""Ranking and validating candidate records, as Spark jobs."""
