"""Joins, filters, aggregations and table jobs."""
