"""Operators of a training-data pipeline: mixing, scoring, sharding, deduplication, extraction.

Nothing outside this subpackage imports it. Every operator takes DataFrames and returns DataFrames; modules
named ``opNN_*`` also hold the thin query that fixes columns and parameters for the driver tables.
"""
