"""Operators for building text corpora: archives, shards, duplicates, contamination, tokens, quality, licences, personal data."""
