"""Tessella: mesh, graph and sparse-matrix analytics on Spark DataFrames."""
