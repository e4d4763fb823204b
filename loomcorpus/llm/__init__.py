"""Training-data operators: deduplication, search, scoring, mixing and packing."""
