"""Training-data operators: deduplication, search, scoring, tokenising and scanning.

Nothing outside this subpackage imports it.
"""
