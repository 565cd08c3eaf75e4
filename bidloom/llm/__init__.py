"""Operators of a training-data pipeline: extraction, quality, mixing, near duplicates, scoring, tokens, archives."""
