"""Catalogue, reading-history and recommendation analytics on Spark DataFrames."""
