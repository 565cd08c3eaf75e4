"""Joins, aggregations, windows and loops that make up the comparison."""
