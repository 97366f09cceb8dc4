"""Operators for preparing training data: filtering, deduplication, packing, search."""
