"""Named queries over the supplied tables and their SQL twins."""

from __future__ import annotations

from . import intake_queries, report_queries, resolve_queries, text_queries, usage_queries

_GROUPS = (text_queries, usage_queries, report_queries, resolve_queries, intake_queries)

QUERIES = {k: f for g in _GROUPS for k, f in g.QUERIES.items()}
ORACLES = {k: q for g in _GROUPS for k, q in g.ORACLES.items()}
flagship = text_queries.flagship
