"""Operators over the chunk relation: each takes and returns DataFrames."""
