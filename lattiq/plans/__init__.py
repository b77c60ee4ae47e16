"""Queries, batches, prepared queries and statistics."""
