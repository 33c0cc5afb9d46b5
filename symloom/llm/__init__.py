"""Training-data operators: quality, dedup, search, mixing, packing and audits."""
