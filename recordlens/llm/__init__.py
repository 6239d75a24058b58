"""Operators for training data: packing, dedup, filters, archives, sharding.

Nothing outside this folder imports it. Every operator takes and returns DataFrames; the
thin queries over the test tables are in ``queries``.
"""
