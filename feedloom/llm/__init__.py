"""Operators for preparing training data: search, scoring, tokens, extraction, duplicates, privacy, mixing."""
