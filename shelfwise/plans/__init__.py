"""Compositions of operators: scoring of submissions, the actual-data cell, and fits of all variants."""
