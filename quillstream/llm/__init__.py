"""Operators of a training-data pipeline: filtering, deduplication, scoring, mixing, archives.

Nothing else in the library imports this subpackage.
"""
