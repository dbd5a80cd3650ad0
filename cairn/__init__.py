"""Terrain and boundary analytics on Spark DataFrames."""
