"""Incremental runners: the batch operators applied to files as they arrive (Structured Streaming)."""
