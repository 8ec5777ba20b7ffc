"""Operators for training corpora: near-duplicates, packing, filters, tokens, language models."""
