"""Training-data operators: deduplication, tokenisation, decontamination, extraction, quality and safety.

Nothing outside this subpackage imports it. ``queries`` holds the registered queries.
"""
