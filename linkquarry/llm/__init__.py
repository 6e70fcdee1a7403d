"""Training-data operators: quality, language, secrets, tokens, licences, leakage, shards, near copies, vectors, BPE."""
