"""Corpus preparation: dedup, language, scans, media, mixing and packing."""
