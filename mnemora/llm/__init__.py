"""Training-data operators: tokenisation, packing, near-duplicates, filters and scans.

Nothing outside this subpackage imports it.
"""
