"""Training-data operators: deduplication, filtering, extraction and packing."""
