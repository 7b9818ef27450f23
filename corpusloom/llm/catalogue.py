"""Queries of this subpackage and SQL that gives the same rows."""

from __future__ import annotations

from corpusloom.llm import (
    bpe, divergence, graph_search, html_text, jaccard_join, near_dups, packing, pii, quality, rules, secrets, stages, substrings, vector_codes,
)

_MODULES = (near_dups, substrings, html_text, bpe, secrets, pii, packing, rules, quality, graph_search, vector_codes, jaccard_join, divergence)

QUERIES = {name: query for m in _MODULES for name, query in m.QUERIES.items()}
#: The pipeline has no SQL either.
ORACLE_SQL = {name: sql for m in _MODULES for name, sql in m.ORACLE_SQL.items()}

QUERIES["pipeline"] = stages.run
