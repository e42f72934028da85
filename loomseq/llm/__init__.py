"""Training-data operators: near duplicates, grouping, splitting, capping, packing, leakage, reading level."""
