"""Training-data operators: sharding, mixing, tokens, media, PII, similarity joins, archives, quality, packing.

Nothing outside this subpackage imports it; its queries are in ``queries``.
"""
