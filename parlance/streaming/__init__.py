"""Incremental annotation with Structured Streaming."""
