"""Trace analytics on Spark DataFrames."""
