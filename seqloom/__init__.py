"""Sequence-structure analytics on Spark DataFrames."""
