"""Operators for large-scale training-data pipelines.

Nothing outside this subpackage imports it.  Each operator lives in a module
of its own with a general interface; ``queries`` holds the thin registered
queries and their SQL.
"""
