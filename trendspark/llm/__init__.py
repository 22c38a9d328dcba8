"""Operators for preparing training data: search, scans, filters, near copies, tokens, mixing.

Nothing outside this package imports it. Each module documents its method, its results for
nulls, empty and very long texts, ties, repeated rows and empty tables, and how it scales.
"""
