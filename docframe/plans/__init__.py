"""Queries before they run: schemas, filters, the query builder, access paths."""
