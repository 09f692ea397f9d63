"""Training-data operators: mixing, search, tokenizing, scoring, filtering and deduplication.

Nothing else in the library imports this subpackage.
"""
