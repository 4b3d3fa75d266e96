"""Operators for training data: duplicates, overlaps, splits, samples, tokens, personal data."""
