"""Operators of a training-data pipeline: filtering, deduplication, extraction, mixing, sharding."""
