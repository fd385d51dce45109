"""Training-data operators (URL lists, token shards, decontamination, dedup, classifiers, WARC).

Nothing else in the library imports this subpackage.
"""
