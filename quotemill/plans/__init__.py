"""Whole pipelines, summaries, and the catalogue of queries with their SQL."""
