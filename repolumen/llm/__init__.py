"""Operators for preparing training text: duplicates, filters, extraction, packing, shards."""
