"""Operators of a training-data pipeline: extraction, filtering, de-duplication, packing.

Nothing else in the library imports this subpackage.
"""
