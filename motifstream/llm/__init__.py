"""Training-data operators: tokenising, de-duplication, media, sharding, classifiers, packing, PII.

Nothing outside this subpackage imports it; it can be deleted without touching the rest.
"""
