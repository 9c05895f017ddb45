"""Operators for preparing language-model training data.

Nothing outside this subpackage imports it.  Every operator is a function from
DataFrames to a DataFrame with its own general interface; the thin registered
queries in ``queries.py`` derive the digest columns from it.
"""
