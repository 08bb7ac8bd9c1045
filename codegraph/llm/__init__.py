"""Operators of a training-data pipeline: archives, near duplicates, private data, filters, shards and mixtures.

Nothing else in the library imports this package.
"""
