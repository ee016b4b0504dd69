"""Operators that are DataFrame programs rather than SQL text."""
