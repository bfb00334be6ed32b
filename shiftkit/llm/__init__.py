"""Operators of a training-data pipeline: mixing, sharding, search, scoring, deduplication, formatting."""
