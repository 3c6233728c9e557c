"""Corpus preparation operators: fingerprints, decontamination, dedup, packing and the like."""
