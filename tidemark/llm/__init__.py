"""Operators of a training-data pipeline: deduplication, packing, sketches, search, scans, mixing."""
