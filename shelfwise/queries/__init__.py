"""Registered queries: the operators over views of the given tables, each with the same result in DuckDB SQL where that can be said."""
