"""Operators of a training-data pipeline: each works on whole tables, as Spark jobs."""
