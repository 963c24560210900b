"""Operators for large-scale training-data pipelines.

Nothing outside this subpackage imports it.  Queries are registered in
``queries.py``, their SQL in ``sql.py``.
"""
