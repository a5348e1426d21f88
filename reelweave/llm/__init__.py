"""Operators for training-data corpora: quality, secrets, chat, toxicity, packing, dedup, encoding, scoring."""
