"""Registered queries: each pairs a Spark query on the given tables with its SQL."""
