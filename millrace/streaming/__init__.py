"""Structured Streaming forms of the parsers."""
