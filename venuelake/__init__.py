"""Venue and location analytics on Spark DataFrames."""
