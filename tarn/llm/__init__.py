"""Training-data operators: packing, sharding, dedup, media, scoring, tokens, PII."""
