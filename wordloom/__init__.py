"""Associative text analytics on Spark DataFrames."""
