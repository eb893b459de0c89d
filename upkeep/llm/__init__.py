"""Operators for training-data pipelines (extraction, filters, near-duplicates, packing).

Nothing else in the library imports this subpackage.
"""
