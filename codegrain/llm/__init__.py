"""Operators of a training-data pipeline: token output, packing, deduplication, classifiers, mixing and chat formatting.

Nothing outside this package imports it.
"""
