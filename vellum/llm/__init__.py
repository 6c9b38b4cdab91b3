"""Training-data operators: dedup, sharding, search, mixing, filters, tokenizing and scoring."""
