"""Operators for building training data from text corpora; nothing else in the package imports them."""
