"""Operators of a training-data pipeline over text, pages and vectors.

Each module holds one operator with a general interface (DataFrames in and
out); ``queries`` applies them to the provided tables. Nothing else in the
library imports this package.
"""
