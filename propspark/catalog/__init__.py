"""Queries over the given tables, one per operator."""
