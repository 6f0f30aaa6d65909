"""Training-data operators: dedup, filtering, extraction, sharding, packing, media and web archives."""
