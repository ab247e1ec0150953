"""Whole plans: rebuild and phrase queries."""
