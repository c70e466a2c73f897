"""Operators for preparing training text: scoring, deduplication, extraction, search, tokenizing.

Nothing else in the library imports this subpackage.
"""
