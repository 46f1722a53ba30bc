"""Training-data operators: deduplication, search, archives, token files, classifiers, extraction.

Nothing outside this subpackage imports it.
"""
