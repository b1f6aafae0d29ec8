"""Operators for large-scale training-data preparation.

Nothing outside this subpackage imports it.  Each module holds one operator
with a general interface; :mod:`loomgraph.llm.queries` holds the thin queries.
"""
