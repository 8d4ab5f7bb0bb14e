"""Ingest, cleaning and stored tables."""
