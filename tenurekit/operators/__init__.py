"""Operators: each takes DataFrames and parameters and returns a DataFrame."""
