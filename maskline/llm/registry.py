"""Queries and oracle SQL of this subpackage, by name."""

from __future__ import annotations

from maskline.llm import align, bpe, decontaminate, html, langid, lm, neardup, phrases, quality, repeats, sharding, urls, warc

MODULES = (align, bpe, decontaminate, html, langid, lm, neardup, phrases, quality, repeats, sharding, urls, warc)

QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
ORACLES = {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
