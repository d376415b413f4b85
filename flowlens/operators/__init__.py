"""Operators: each takes and returns DataFrames and leaves the physical plan to Catalyst."""
