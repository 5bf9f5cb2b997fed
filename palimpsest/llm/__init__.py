"""Operators for large-scale training-data pipelines.

Nothing else in the library imports this subpackage, so it may be removed as a
whole. Each module holds one operator with its own general interface; the thin
``opN_`` queries that digest their outputs are in :mod:`palimpsest.llm.queries`.
"""
