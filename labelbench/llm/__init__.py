"""Training-data operators: scoring, near-duplicate removal, cleaning, mixing, packing, sharding."""
