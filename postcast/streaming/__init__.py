"""Structured Streaming form of the index and statistics build."""
