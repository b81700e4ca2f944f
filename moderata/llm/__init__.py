"""Operators of a training-data pipeline, and their queries. Nothing else in the library imports them."""
