"""Retail-demand scoring and estimation on Spark DataFrames."""
