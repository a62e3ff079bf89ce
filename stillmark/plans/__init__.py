"""Whole queries: search, duplicates and ingest, and their mapping onto the driver's tables."""
