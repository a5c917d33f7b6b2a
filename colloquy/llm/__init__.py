"""Operators for large text corpora: archives, deduplication, filtering, mixing, tokenising, scoring, chat formatting.

Nothing else in the library imports this subpackage.
"""
