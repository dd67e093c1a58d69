"""Operators for preparing training data: fingerprints, scans, packing, sharding, deduplication, filters."""
