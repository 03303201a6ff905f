"""Operators of the text cube: every function takes and returns DataFrames."""
