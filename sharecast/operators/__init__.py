"""Relational operators of the popularity workload, expressed with DataFrames."""
