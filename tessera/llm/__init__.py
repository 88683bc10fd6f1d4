"""Operators for large-scale training-data pipelines.

Self-contained: nothing outside this subpackage imports it.  Queries are in
``queries.py`` and their SQL in ``oracles.py``.
"""
