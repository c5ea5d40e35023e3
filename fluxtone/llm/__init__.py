"""Operators for preparing training text: scoring, deduplication, mixing, packing, sharding and search."""
