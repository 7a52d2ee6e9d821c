"""Volumetric scan analytics on Spark DataFrames."""
