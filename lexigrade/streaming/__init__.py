"""Incremental maintenance with Structured Streaming and its batch equivalents."""
