"""Training-data operators: fingerprints, tokenization, filtering, deduplication and mixing at corpus scale."""
