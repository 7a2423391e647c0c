"""Training-data operators: deduplication, decontamination, scoring, packing and sharding of text corpora.

Nothing outside this subpackage imports it.
"""
