"""Skeinlake: web-corpus analytics on Spark DataFrames."""
