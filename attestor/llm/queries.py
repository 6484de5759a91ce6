"""The queries of this subpackage and their SQL, for ``__spark_entry__.py``."""

from __future__ import annotations

from . import ann, bpe, licences, line_dedup, mixing, negatives, ngram_join, periodic, preferences, quality, sharding, toxicity, warc

_MODULES = (mixing, bpe, quality, warc, sharding, toxicity, ngram_join, ann, licences, preferences, line_dedup, periodic, negatives)
QUERIES = {name: query for m in _MODULES for name, query in m.QUERIES.items()}
ORACLES = {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}
