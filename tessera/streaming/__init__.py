"""Incremental block statistics over Structured Streaming."""
