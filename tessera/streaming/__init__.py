"""Structured Streaming forms of the grouped aggregates (extension)."""
