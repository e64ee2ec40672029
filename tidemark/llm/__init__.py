"""Training-data operators: filtering, deduplication, search and tokenization of text tables."""
