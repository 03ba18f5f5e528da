"""Structured Streaming forms of the row-local and windowed operators."""
