"""Training-data operators: mixing, filtering, de-duplication, search, encoding and sharding of text corpora.

Nothing outside this subpackage imports it, so it can be removed as a whole.
"""
