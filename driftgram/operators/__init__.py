"""Operators on texts, counts and series."""
