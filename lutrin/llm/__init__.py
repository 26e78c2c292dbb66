"""Operators of a training-data pipeline: packing, mixing, filters, extraction, near-duplicates, archives."""
