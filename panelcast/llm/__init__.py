"""Training-data operators: search, deduplication, scoring, mixing, formatting, packing.

Nothing outside this subpackage imports it; ``__spark_entry__`` adds its
queries when it is present.
"""
