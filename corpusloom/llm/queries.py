"""The registered queries of the training-data problems."""

from __future__ import annotations

from corpusloom.llm.catalog import p1, p2, p3, p4, p5, p6, p8, p9, p10

_PARTS = (p1, p2, p3, p4, p5, p6, p8, p9, p10)
QUERIES = {name: query for part in _PARTS for name, query in part.QUERIES.items()}
ORACLE = {name: sql for part in _PARTS for name, sql in part.ORACLE.items()}
