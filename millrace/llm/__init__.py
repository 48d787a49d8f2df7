"""Training-data operators: language identification, near-duplicates, pseudonyms, mixing, packing,
tokenised output, fingerprints, toxicity, media columns and web archives.

Nothing outside this subpackage imports it.
"""
