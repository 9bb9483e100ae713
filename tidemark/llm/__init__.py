"""Training-data operators for text corpora (quality, dedup, tokens, web archives, secrets, mixing)."""
