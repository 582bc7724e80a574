"""Operators for training corpora: filters, dedup, mixing, packing, sharding, archives, sketches."""
