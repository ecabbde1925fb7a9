"""Incremental matching over Structured Streaming."""
