"""Raster operators over cell and tile DataFrames."""
