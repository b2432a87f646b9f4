"""The registered queries: inputs derived from the given tables, and check SQL."""
