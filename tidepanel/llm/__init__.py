"""Training-corpus operators on Spark: extraction, near-duplicates, PII, search, sharding, language, chat, mixing, packing."""
