"""Filters, joins, order, pages, nesting and aggregation."""
