"""Operators on graphs that are two DataFrames, vertices and edges."""
