"""Corpus operators: tokens, deduplication, archives, extraction, search, packing, quality."""
