"""Governed knowledge-graph analytics on Spark DataFrames."""
