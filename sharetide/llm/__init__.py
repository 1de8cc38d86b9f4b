"""Operators for training-text corpora.  Nothing outside this package imports it."""
