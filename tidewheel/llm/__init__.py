"""Operators that prepare text corpora for training: one module per operator, queries in queries.py."""
