"""Queries: the jobs over the given tables."""
