"""Operators over statement tables. All take DataFrames and return DataFrames; none collects."""
