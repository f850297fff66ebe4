"""Structured Streaming forms of the cell operators."""
