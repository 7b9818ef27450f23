"""A corpus pipeline of five stages, each written as Parquet before the next.

Every stage takes all rows that its predecessor kept.  The last returns packed
pieces instead of documents.  The stages, and what they do with odd tables, are
in ``corpusloom.llm.stages``.
"""

from __future__ import annotations

from corpusloom.llm.stages import STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]

#: No stage can be expressed in SQL; tests hold each against a brute-force version.
ORACLE_SQL = None
