"""Operators for training-data corpora: deduplication, tokenization, filtering and packing of documents."""
