"""Training-data operators: fingerprints, near copies, filters, encoding, sharding."""
