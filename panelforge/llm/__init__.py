"""Training-data operators: deduplication, filtering, extraction, tokenisation and scans over document tables."""
