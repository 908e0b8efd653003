"""Part of the confluo engine."""
