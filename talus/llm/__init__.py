"""Operators for large text corpora: each is a function from DataFrame to DataFrame."""
