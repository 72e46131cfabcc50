"""Operators for large text corpora: deduplication, filtering, scoring, encoding, packing, search."""
