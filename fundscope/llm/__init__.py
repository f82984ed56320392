"""Training-data operators (near-duplicates, sharding, decontamination, mixing, WARC, toxicity,
chat formatting, exact top-k, personal data, repeated passages). Nothing outside imports this."""
