"""Training-data operators: tokenization, sharding, scans, near-duplicates and archives."""
