"""Terrain-raster analytics on Spark DataFrames."""
