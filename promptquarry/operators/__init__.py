"""Operators over the corpus tables; each takes and returns DataFrames."""
