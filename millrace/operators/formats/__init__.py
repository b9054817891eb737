"""Parsers, one module per log format."""
