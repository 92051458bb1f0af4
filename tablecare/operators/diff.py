"""Version comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.predicates import quoted as q
from .rowid import ROW_ID


def removed_rows(before: DataFrame, after: DataFrame, id_col: str = ROW_ID) -> DataFrame:
    """The rows a step removed.

    With a row id on both sides this is an anti join on the unique id (no hot
    keys).  Without ids it is the bag difference on the common columns
    (null-safe, duplicates counted, ``exceptAll``)."""
    if id_col in before.columns and id_col in after.columns:
        return before.join(after.select(id_col), id_col, "left_anti")
    common = [c for c in before.columns if c in after.columns]
    names = [F.col(q(c)) for c in common]
    return before.select(*names).exceptAll(after.select(*names))


def removed_counts(before: DataFrame, after: DataFrame) -> DataFrame:
    """D1 as the reference previews it: each distinct row with the number of
    copies removed (bag difference without replicating rows)."""
    common = [c for c in before.columns if c in after.columns]
    key = F.struct(*[F.col(q(c)).alias(c) for c in common])
    b = before.groupBy(key.alias("_r")).agg(F.count(F.lit(1)).alias("_b"))
    a = after.groupBy(key.alias("_r")).agg(F.count(F.lit(1)).alias("_a"))
    j = b.join(a.withColumnRenamed("_r", "_ra"), F.col("_r").eqNullSafe(F.col("_ra")), "left")
    n = F.col("_b") - F.coalesce(F.col("_a"), F.lit(0))
    return j.where(n > 0).select("_r.*", n.alias("removed"))


def changed_rows(before: DataFrame, after: DataFrame, id_col: str = ROW_ID) -> DataFrame:
    """Rows (by id) where any common column differs, null-safe; with the
    list of changed columns.  One join on the unique id."""
    common = [c for c in before.columns if c in after.columns and c != id_col]
    b = before.select(id_col, *[F.col(q(c)).alias(f"b_{i}") for i, c in enumerate(common)])
    a = after.select(id_col, *[F.col(q(c)).alias(f"a_{i}") for i, c in enumerate(common)])
    j = b.join(a, id_col)
    diffs = [(c, ~F.col(f"b_{i}").eqNullSafe(F.col(f"a_{i}").cast(before.schema[c].dataType))) for i, c in enumerate(common)]
    arr = F.filter(F.array(*[F.when(p, F.lit(c)) for c, p in diffs]), lambda x: x.isNotNull())
    return j.select(id_col, arr.alias("changed_columns")).where(F.size("changed_columns") > 0)


def step_summary(before: DataFrame, after: DataFrame, id_col: str = ROW_ID, changed=changed_rows) -> DataFrame:
    """J6 metrics as one row: dropped columns, removed rows, changed cells
    (dropped columns count every row), rows remaining.  Rows are compared, by
    ``changed``, only where none was removed."""
    dropped = [c for c in before.columns if c not in after.columns]
    nb, na = before.count(), after.count()
    n = F.lit(0)
    if nb <= na and dropped:
        n = F.lit(nb * len(dropped))
    elif nb <= na and id_col in before.columns and id_col in after.columns:
        n = changed(before, after, id_col).agg(F.count(F.lit(1))).scalar()
    return before.sparkSession.range(1).select(
        F.lit(",".join(dropped)).alias("dropped_columns"),
        F.lit(max(nb - na, 0)).cast("bigint").alias("rows_removed"),
        n.cast("bigint").alias("values_changed"),
        F.lit(na).cast("bigint").alias("rows_remaining"))
