"""Structured Streaming versions of the row-wise rules."""
