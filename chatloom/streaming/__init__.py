"""Incremental work on Structured Streaming."""
