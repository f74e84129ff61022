"""Training-data operators: packing, scans, quality, deduplication, tokens, search."""
