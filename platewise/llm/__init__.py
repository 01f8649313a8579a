"""Operators of a training-data pipeline (quality, dedup, sharding, search,
archives, tokenising, privacy, mixing, toxicity). Nothing outside this
subpackage imports it; ``queries.py`` holds the registered queries."""
