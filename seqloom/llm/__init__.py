"""Operators for text corpora and large score tables.  Nothing outside this package imports it."""
