"""Streaming use of the row-level predicates.

The reference reads whole files and has no streaming operator, so nothing
here adds semantics.  The cell predicates (missing, empty, patterns) are
stateless ``Column`` expressions, and the per-column missing/empty counters
(E8) are a plain aggregate: both run unchanged on a ``readStream`` source,
where Structured Streaming keeps the running counts as state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import predicates as P


def missing_empty_counts(df: DataFrame, tokens=P.MISSING_TOKENS) -> DataFrame:
    """E8 counters ``(rows, <col>_missing, <col>_empty ...)`` as one aggregate;
    valid on batch and streaming frames (use ``outputMode("complete")``)."""
    aggs = [F.count(F.lit(1)).alias("rows")]
    for f in df.schema.fields:
        aggs += [F.count_if(P.is_missing(f.name, f.dataType, tokens)).alias(f"{f.name}_missing"),
                 F.count_if(P.is_empty(f.name, f.dataType)).alias(f"{f.name}_empty")]
    return df.agg(*aggs)


def flag_cells(df: DataFrame, tokens=P.MISSING_TOKENS) -> DataFrame:
    """Per-row ``_missing_cols`` / ``_empty_cols`` (stateless, stream-safe)."""
    fields = df.schema.fields
    return df.select("*",
                     P.flagged_names([(f.name, P.is_missing(f.name, f.dataType, tokens)) for f in fields])
                     .alias("_missing_cols"),
                     P.flagged_names([(f.name, P.is_empty(f.name, f.dataType)) for f in fields]).alias("_empty_cols"))
