"""Training-data operators: scoring, quality rules, extraction, tokens, packing, dedup, search, archives.

Nothing outside this subpackage imports it; it uses only Spark and the
installed tokenizer, hashing and compression libraries.
"""
