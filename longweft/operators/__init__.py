"""Operators from sketches to assemblies, each a function from DataFrames to a DataFrame."""
