"""Training-data operators: quality, deduplication, privacy, tokenization, packing and archives."""
