"""Training-data operators: dedup, tokenisation, language, quality, sharding, packing.

Nothing outside this subpackage imports it.
"""
