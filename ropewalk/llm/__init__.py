"""Training-data operators: language id, tokens, mixing, joins, chat, dedup, scoring, quality, fingerprints."""
