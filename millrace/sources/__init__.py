"""Readers that turn logs into rows of lines."""
