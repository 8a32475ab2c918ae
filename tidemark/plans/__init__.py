"""Registered queries (catalog), their SQL statements (oracle) and the
streaming runs they share (scenarios)."""
