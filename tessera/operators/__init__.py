"""Relational building blocks: selection, aggregation and joins."""
