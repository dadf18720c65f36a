"""Streaming ingest into collections."""
