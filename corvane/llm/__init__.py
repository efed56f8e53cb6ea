"""Training-data operators: dedup, quality, privacy, filtering, mixing, sharding, token output."""
