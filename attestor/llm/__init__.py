"""Operators of training-data pipelines: quality, deduplication, tokenising, mixing, search.

Nothing outside this folder imports it; ``__spark_entry__.py`` adds its queries
only where it can be imported.
"""
