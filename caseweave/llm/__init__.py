"""Training-data operators: deduplication, filtering, mixing, formatting and packing of text corpora."""
