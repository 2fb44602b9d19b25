"""Training-data operators: sharding, dedup, sanitising, tokenising, joins, search, mixing and quality scores."""
