"""Training-data operators: sharding, tokenisation, deduplication, packing, language and licence scans.

Nothing outside this subpackage imports it; ``queries`` holds the driver queries.
"""
