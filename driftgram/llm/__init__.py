"""Operators for preparing language-model training data. Nothing outside imports this subpackage."""
