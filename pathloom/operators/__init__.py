"""Operators over node, edge, path and response DataFrames."""
