"""Spark jobs that turn text events into cross-sectional equity factors, and prepare text corpora."""
