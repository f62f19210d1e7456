"""Training-data operators: sharding, language, licences, near-duplicates, toxicity, mixing, quality, fingerprints, packing.

Nothing outside this subpackage imports it.
"""
