"""Duplicate rows.

Groups are found by aggregation (partial aggregation absorbs a hot key before
the shuffle); row-level answers join back on the unique ``_row_id`` or on the
small set of reported groups, so no group is ever gathered into one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import predicates as P
from .analysis import normalised
from .rowid import ROW_ID, ensure_row_id


def dup_key(df: DataFrame, keys=None, normalise: bool = True, tokens=P.MISSING_TOKENS) -> Column:
    types = {f.name: f.dataType for f in df.schema.fields}
    keys = list(keys or [c for c in df.columns if c != ROW_ID])
    if normalise:
        return F.struct(*[normalised(c, types[c], tokens).alias(c) for c in keys])
    return F.struct(*[F.col(P.quoted(c)).alias(c) for c in keys])


def duplicate_groups(df: DataFrame, keys=None, order_by=None, max_groups: int = 100, max_ids: int = 5,
                     normalise: bool = True) -> DataFrame:
    """First ``max_groups`` duplicate groups in first-seen order:
    ``(first_row_id, group_rows, duplicate_row_ids, total_duplicates)`` where
    ``duplicate_row_ids`` lists the next ``max_ids`` members."""
    d = ensure_row_id(df, order_by)
    k = dup_key(d, keys, normalise)
    d = d.select(k.alias("_k"), ROW_ID)
    groups = (d.groupBy("_k").agg(F.count(F.lit(1)).alias("group_rows"), F.min(ROW_ID).alias("first_row_id"))
                .where(F.col("group_rows") > 1))
    top = groups.orderBy("first_row_id").limit(max_groups)            # bounded: max_groups rows
    members = d.join(F.broadcast(top.withColumnRenamed("_k", "_tk")), F.col("_k").eqNullSafe(F.col("_tk")))
    members = members.where(F.col(ROW_ID) != F.col("first_row_id"))
    w = Window.partitionBy("first_row_id").orderBy(ROW_ID)
    # row_number() <= k is planned with a partial group limit before the shuffle
    firsts = members.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= max_ids)
    ids = firsts.groupBy("first_row_id").agg(F.sort_array(F.collect_list(ROW_ID)).alias("duplicate_row_ids"))
    return (top.join(ids, "first_row_id")
               .select("first_row_id", "group_rows", "duplicate_row_ids",
                       (F.col("group_rows") - 1).alias("total_duplicates")))


def duplicate_totals(df: DataFrame, keys=None, normalise: bool = True) -> DataFrame:
    """Rows belonging to a duplicate group (all members) and group count."""
    k = dup_key(df, keys, normalise)
    g = df.groupBy(k.alias("_k")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    return g.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("duplicate_rows"), F.count(F.lit(1)).alias("duplicate_groups"))


def extra_duplicates(df: DataFrame) -> DataFrame:
    """Rows minus distinct rows (raw values)."""
    return (df.groupBy(*[F.col(P.quoted(c)) for c in df.columns]).agg(F.count(F.lit(1)).alias("_n"))
              .agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("extra_duplicates")))


def keep(df: DataFrame, keys=None, which: str = "first", order_by=None, normalise: bool | None = None) -> DataFrame:
    """One row per duplicate group.

    ``which`` = ``first`` | ``last`` | ``most_complete`` (most non-null cells,
    then first).  The survivor id of each group comes from an aggregate; the
    rows are then kept with a semi join on the unique ``_row_id``.
    """
    had_id = ROW_ID in df.columns
    d = ensure_row_id(df, order_by)
    all_cols = [c for c in df.columns if c != ROW_ID]
    if normalise is None:
        normalise = keys is None  # whole rows compare normalised, a subset raw
    k = dup_key(d, keys or all_cols, normalise)
    if which == "first":
        pick = F.min(ROW_ID)
    elif which == "last":
        pick = F.max(ROW_ID)
    elif which == "most_complete":
        filled = P.non_null_count([F.col(P.quoted(c)).isNotNull() for c in all_cols])
        pick = F.min_by(F.col(ROW_ID), F.struct((-filled).alias("f"), F.col(ROW_ID).alias("i")))
    else:
        raise ValueError(which)
    survivors = d.groupBy(k.alias("_k")).agg(pick.alias("_keep"))
    out = d.join(survivors.select(F.col("_keep").alias(ROW_ID)), ROW_ID, "left_semi")
    return out if had_id else out.drop(ROW_ID)
