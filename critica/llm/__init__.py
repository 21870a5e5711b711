"""Training-data operators: packing, token output, deduplication, filtering, search and extraction."""
