"""Batch sinks (K2)."""
