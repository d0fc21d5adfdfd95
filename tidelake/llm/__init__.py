"""Training-data operators: archives, packing, scoring, scanning, deduplication and sharding."""
