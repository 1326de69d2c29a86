"""Operators from DataFrames to DataFrames, keyed by ``cell_slug`` so that all cells are done in one job."""
