"""Queries over the given tables, one or more per operation, with their SQL."""
