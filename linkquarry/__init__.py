"""URL corpora on Spark: canonical links, sampled, split, verified, scored and packed."""
