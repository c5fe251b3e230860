"""Operators for large text and embedding corpora: mixing, near duplicates, search, sharding,
token files, personal data, toxicity and tokenizing. Nothing else in the library imports this."""
