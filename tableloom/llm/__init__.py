"""Operators for training data: dedup, scoring, packing, decontamination, archives, shards, secrets, search, languages."""
