"""Operators of a training-data pipeline: filters, joins, extraction, mixing, sharding."""
