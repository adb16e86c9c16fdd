"""Operators for building training data: language identification, deduplication, tokens, packing, sharding."""
