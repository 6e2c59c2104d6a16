"""Training-data operators: tokens, secrets, lines, search, language, substrings, quality, packing, near copies, toxicity."""
