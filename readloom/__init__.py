"""Sequence-read overlap, search and assembly on Spark DataFrames."""
