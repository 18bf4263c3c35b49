"""Operators of a training-data pipeline on document tables."""
