"""Operators that prepare training text: scans, deduplication, filters, tokens, packing."""
