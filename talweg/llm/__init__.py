"""Training-data operators: cleaning, formatting, mixing, scoring, deduplication, archives and tokens.

Nothing outside this subpackage imports it; `queries.py` holds the registered queries.
"""
