"""Operators for building training data from text corpora. Nothing else in the library imports this subpackage."""
