"""Operators of a training-data pipeline: deduplication, classification, scoring, redaction and mixing.

Nothing else in the library imports this subpackage.
"""
