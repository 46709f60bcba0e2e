"""Hybrid search over vectors and words, its index upkeep and evaluation, on Spark DataFrames."""
