"""Training-data operators: language, duplicates, quality, tokens and shards."""
