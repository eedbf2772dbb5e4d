"""Operators for large text corpora: one module each, plus the queries that apply them."""
