"""Operators for training-data preparation (problems 1-4 and 6-8)."""
