"""Operators that prepare training text: dedup, fingerprints, tokenisation, packing, sharding, archives, quality."""
