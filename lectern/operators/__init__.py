"""Relational operators of the review engine, over DataFrames."""
