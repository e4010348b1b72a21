"""Training-data operators: deduplication, filtering, mixing, formatting, packing and search.

Nothing outside this subpackage imports it.
"""
