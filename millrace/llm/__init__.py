"""Operators for large-scale training-data pipelines.

Each module holds one operator with its own general interface; ``queries``
holds the thin registered queries ``opN_<name>`` over the shared tables.
Nothing outside this subpackage imports it.
"""
