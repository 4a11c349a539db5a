"""Training-data operators: mixing, filtering, scanning, joining, sharding and packing of text tables."""
