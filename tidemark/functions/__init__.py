"""Scalar column functions and the record schema."""
