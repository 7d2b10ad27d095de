"""Operators of a training-data pipeline: filters, near duplicates, token work and archives over document tables."""
