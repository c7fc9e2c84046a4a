"""Operators for preparing training data: each takes DataFrames and returns DataFrames."""
