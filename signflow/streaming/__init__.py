"""Incremental counts with Structured Streaming."""
