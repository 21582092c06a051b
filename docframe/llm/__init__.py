"""Training-data operators: counting, fingerprinting, deduplication, scoring and encoding of text."""
