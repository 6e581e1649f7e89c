"""Operators for preparing text corpora for training.

Each module holds one operator with its own general interface; ``queries`` binds
them to the given tables.  Nothing outside this package imports it.
"""
