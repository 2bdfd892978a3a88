"""Training-data operators: one module each, their queries in ``queries``.

Nothing else in the library imports this sub-package; it may be removed whole.

simhash        near-duplicate groups of 64-bit fingerprints through pivot distance tables
warc           WARC archives: one gzip member per record, sequential reader
mixing         source mixing by weighted exponential keys and token budgets
sharding       longest-processing-time assignment of text groups to shards
toxicity       cumulative-link ordinal severity model on sparse text features
katz           Katz back-off language model with Good-Turing discounts
decontaminate  BM25 / block-max WAND retrieval of benchmark items, overlap verification
winnowing      winnowed k-gram fingerprints
secrets        multipart credential linking (DataFrame functions only)
reputation     empirical-Bayes host reputation URL filter
"""
