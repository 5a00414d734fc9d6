"""Operators for preparing text corpora: dedup, filtering, search, mixing, identification, tokens, quality."""
