"""Operators for corpora of training data, one module each.

Nothing else in the library imports this subpackage. ``queries`` holds its queries and their SQL.
"""
