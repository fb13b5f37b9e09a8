"""Operators: DataFrames and column names in, DataFrames out, all lazy."""
