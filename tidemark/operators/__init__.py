"""Operators on DataFrames: record encode/decode and projections, grouped
counts and other aggregates, ordering, and the audit."""
