"""Operators on DataFrames: diffs, merges, conflict-free replicated values, indexes."""
