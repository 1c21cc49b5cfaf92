"""Training-data operators on Spark DataFrames: dedup, decontamination, mixing, sharding, PII, HTML, language, search."""
