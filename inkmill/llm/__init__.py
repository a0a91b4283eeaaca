"""Operators for preparing training text: deduplication, language, toxicity, personal data,
extraction, search, tokenisation and packing.  Nothing outside this subpackage imports it."""
