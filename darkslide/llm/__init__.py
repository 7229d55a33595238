"""Operators for training data: duplicates, splits, leaks, tokens, damaged text."""
