"""Operators on lines and events."""
