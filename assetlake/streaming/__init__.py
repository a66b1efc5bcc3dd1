"""Incremental arrival."""
