"""Diversity analytics on Spark DataFrames."""
