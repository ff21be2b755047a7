"""Operators for training data: text quality, near copies, contamination, tokens, shards and pages.

Every operator takes and returns DataFrames. Nothing else in the library imports this subpackage.
"""
