"""Batch approximate nearest-neighbour search over integer vectors, planned as Spark DataFrames."""
