"""Training-data operators: language, duplicates, quality, secrets, licences, mixing, archives, tokens."""
