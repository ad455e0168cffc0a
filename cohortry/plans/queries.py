"""All registered queries of the core library, and their SQL."""

from __future__ import annotations

from . import cohort_queries, context_queries, domain_queries, graph_text_queries, score_queries
from .base import per_query

MODULES = [cohort_queries, score_queries, graph_text_queries, domain_queries, context_queries]
QUERIES = {k: per_query(v) for m in MODULES for k, v in m.QUERIES.items()}
ORACLES = {k: v for m in MODULES for k, v in m.ORACLES.items()}
