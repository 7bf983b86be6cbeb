"""Operators of a training-data pipeline.

Nothing outside this subpackage imports it.  Each module holds one operator with
its own general interface; ``queries`` holds the thin registered queries and the
SQL they are held against.
"""
