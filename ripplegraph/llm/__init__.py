"""Operators for preparing training text: archives, packing, deduplication, filtering, scoring and sharding."""
