"""Operators for training-data pipelines: dedup, filters, scans, extraction and tokenization.

Nothing outside this package imports it; removing the folder leaves the rest of the library working.
"""
