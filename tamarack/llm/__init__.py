"""Training-data operators: fingerprints, line and substring dedup, mixing, toxicity, secrets, packing, joins, rules."""
