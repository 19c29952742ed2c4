"""Operators of a training-data pipeline: dedup, quality, privacy, tokens, sharding, packing."""
