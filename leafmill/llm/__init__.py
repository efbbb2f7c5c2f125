"""Training-data operators: scoring, archives, filtering, deduplication, sharding, encoding and packing."""
