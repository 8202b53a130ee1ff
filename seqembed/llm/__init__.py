"""Operators for training data: deduplication, filtering, scoring, sharding and tokenizing of documents."""
