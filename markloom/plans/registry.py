"""Every query of the assessment operators by name, and the SQL that checks it."""

from __future__ import annotations

from markloom.plans import label_queries, matching_queries, review_queries, extraction_queries, layout_queries, intake_queries, reply_queries

_PARTS = (label_queries, matching_queries, review_queries, extraction_queries, layout_queries, intake_queries, reply_queries)
QUERIES: dict = {name: f for part in _PARTS for name, f in part.QUERIES.items()}
ORACLES: dict = {name: s for part in _PARTS for name, s in part.ORACLES.items()}
