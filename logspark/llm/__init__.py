"""Operators for preparing training text: rules, duplicates, extraction, classifiers, tokens, sharding, search."""
