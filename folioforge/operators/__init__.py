"""Relational and ranking operators: each maps DataFrames to a DataFrame."""
