"""All queries of the core library and their SQL."""

from __future__ import annotations

from . import intervals, scores, sources, speech, terms, text

FLAGSHIP = "normalize_dispatch"
PARTS = [intervals, text, terms, scores, speech, sources]
QUERIES = {k: f for p in PARTS for k, f in p.QUERIES.items()}
SQL = {k: q for p in PARTS for k, q in p.SQL.items()}
