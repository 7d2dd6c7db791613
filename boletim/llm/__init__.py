"""Operators for preparing training text: extraction, filters, duplicates, mixing, tokens, shards."""
