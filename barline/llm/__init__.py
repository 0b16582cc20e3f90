"""Training-data operators: scoring, secrets, deduplication, language, quality, packing."""
