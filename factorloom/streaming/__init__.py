"""Structured Streaming versions of the incremental ingest operators."""
