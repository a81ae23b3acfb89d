"""Structured Streaming: incremental indexing."""
