"""Table view operators: filters (B7, B8), search (B11, B12), sort (G1, G6),
page (G2), head (G4), samples (G5, G7) and the flagged table page (J1)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from ..functions import predicates as P
from .rowid import ROW_ID, ensure_row_id


def apply_filters(df: DataFrame, filters: dict) -> DataFrame:
    """``{col: [values]}`` membership (empty list = no filter) and
    ``{col: {"min": a, "max": b}}`` inclusive ranges; unknown columns are
    skipped.  Plain predicates, so Catalyst pushes them into the scan."""
    out = df
    for col, spec in (filters or {}).items():
        if col not in df.columns:
            continue
        if isinstance(spec, (list, tuple, set)):
            if spec:
                out = out.where(F.col(P.quoted(col)).isin(list(spec)))
        elif isinstance(spec, dict):
            if spec.get("min") is not None:
                out = out.where(F.col(P.quoted(col)) >= F.lit(spec["min"]))
            if spec.get("max") is not None:
                out = out.where(F.col(P.quoted(col)) <= F.lit(spec["max"]))
    return out


def search(df: DataFrame, term: str, regex: bool = False, all_types: bool = False, columns=None) -> DataFrame:
    """Rows where any text column (or, with ``all_types``, any
    column as text) contains ``term``, case-insensitively.  A literal
    substring by default; ``regex=True`` treats the term as a pattern.
    ``columns`` restricts the search to some columns."""
    if not term:
        return df
    t = term.lower()
    preds = []
    for f in df.schema.fields:
        if f.name == ROW_ID or (columns is not None and f.name not in columns):
            continue
        if P.is_string(f.dataType):
            x = F.lower(F.col(P.quoted(f.name)))
        elif all_types:
            x = F.lower(P.as_text(P.quoted(f.name), f.dataType))
        else:
            continue
        preds.append(x.rlike(t) if regex else x.contains(t))
    if not preds:
        return df
    cond = preds[0]
    for p in preds[1:]:
        cond = cond | p
    return df.where(F.coalesce(cond, F.lit(False)))


def sort_by(df: DataFrame, col: str | None, desc: bool = False, tie: str | None = ROW_ID) -> DataFrame:
    """G1: one sort column, nulls first in both directions, ties by row id."""
    if not col or col not in df.columns:
        return df.orderBy(tie) if tie and tie in df.columns else df
    key = F.col(P.quoted(col)).desc_nulls_first() if desc else F.col(P.quoted(col)).asc_nulls_first()
    keys = [key] + ([F.col(tie)] if tie and tie in df.columns else [])
    return df.orderBy(*keys)


def sort_as_text(df: DataFrame, col: str, desc: bool = False) -> DataFrame:
    """Null as blank, case-insensitive for text, numeric for numbers."""
    dt = df.schema[col].dataType
    x = F.col(P.quoted(col))
    key = x if P.is_numeric(dt) else F.lower(F.coalesce(x.cast("string"), F.lit("")))
    keys = [key.desc() if desc else key.asc()] + ([F.col(ROW_ID)] if ROW_ID in df.columns else [])
    return df.orderBy(*keys)


def page(df: DataFrame, page_no: int = 1, limit: int = 100) -> DataFrame:
    """Rows ``(page-1)*limit .. page*limit`` of an ordered frame; ``limit<=0``
    returns everything."""
    if limit <= 0:
        return df
    return df.offset(max(0, (page_no - 1) * limit)).limit(limit)


def total_pages(total_rows: int, limit: int) -> int:
    return 1 if limit <= 0 else max(1, math.ceil(total_rows / limit))


def head(df: DataFrame, n: int = 5, max_cols: int | None = None, order: str = ROW_ID) -> DataFrame:
    """First ``n`` rows by row id, optionally the first ``max_cols`` columns."""
    cols = [c for c in df.columns if c != order]
    if max_cols:
        cols = cols[:max_cols]
    d = df.orderBy(order) if order in df.columns else df
    return d.select(*[F.col(P.quoted(c)) for c in cols]).limit(n)


def hash_sample(df: DataFrame, n: int, seed: int = 42, id_col: str = ROW_ID, key: list[str] | None = None) -> DataFrame:
    """``n`` rows.  Every row draws a number of its own and the ``n``
    smallest win (a top-k, no full sort), so equal rows are in or out one by
    one.  The number is the md5 of the seed and ``key``, columns that tell rows
    apart, or else of the seed and the row id: the sample then depends on the
    rows alone.  Without either it comes from a seeded generator, and the same
    table read in the same splits gives the same sample."""
    key = key or ([id_col] if id_col in df.columns else None)
    draw = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(P.quoted(k)).cast("string") for k in key])) if key else F.rand(seed)
    return df.withColumn("_draw", draw).orderBy("_draw").limit(n).drop("_draw")


def even_sample(df: DataFrame, n: int = 100, total: int | None = None, id_col: str = ROW_ID) -> DataFrame:
    """``n`` evenly spaced rows by row id (``linspace(0, total-1, n)``)."""
    d = ensure_row_id(df)
    total = total if total is not None else d.count()
    if total <= n:
        return d
    ids = sorted({int((total - 1) * i / (n - 1)) for i in range(n)})
    return d.where(F.col(id_col).isin(ids))
