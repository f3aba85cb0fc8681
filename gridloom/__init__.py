"""Gridded climate downscaling and forecast verification on Spark DataFrames."""
