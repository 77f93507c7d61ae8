"""Training-data operators: filters, near-duplicate detection, tokenising, packing and sharding of documents."""
