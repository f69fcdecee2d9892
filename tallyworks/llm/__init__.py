"""Operators for large-scale training-data preparation.

Nothing outside this subpackage imports it; the queries are in ``queries.py``.
"""
