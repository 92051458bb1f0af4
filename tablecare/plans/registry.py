"""All registered queries: ``name -> (spark_fn, oracle_sql | None)``."""

from __future__ import annotations

from .sqlgen import bigint_counts
from . import chart_queries, check_queries, clean_queries, dashboard_queries, io_queries, quality_queries, report_queries, scale_queries

REGISTRY: dict = {}
for _mod in (quality_queries, clean_queries, chart_queries, report_queries, dashboard_queries, io_queries, scale_queries, check_queries):
    for _name, (_fn, _sql) in _mod.QUERIES.items():
        REGISTRY[_name] = (_fn, bigint_counts(_sql) if _sql else None)
