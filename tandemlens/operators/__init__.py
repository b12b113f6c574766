"""Relational operators: every one takes and returns lazy DataFrames."""
