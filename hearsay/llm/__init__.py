"""Operators of a training-data pipeline over landed documents; nothing outside this package uses them."""
