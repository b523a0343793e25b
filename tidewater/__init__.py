"""Ordered-panel analytics on Spark DataFrames."""
