"""Order-dependent fills (F2-F4) without a single-partition window.

A plain ``last(x, true) OVER (ORDER BY id)`` plans as ``Exchange
SinglePartition``.  Here rows are cut into blocks of consecutive ids:

1. per block, the last (first) usable value -- an aggregate, one row per block;
2. a two-level scan carries the value across blocks: blocks are cut into groups
   of ``FAN`` consecutive ones, a window inside each group carries it from block
   to block, and the groups' own last values are carried the same way over
   groups of groups;
3. inside each block a window partitioned by block finds the local value;
4. ``coalesce(local, carried)``.

Every window sees at most one block of rows or ``FAN`` rows of a level above: no
window runs over a whole table, not over that of the blocks either.  A large
table gets a task for every ``TASK_ROWS`` rows, so what a task sorts does not
grow with the table.  Two
levels reach 2**48 rows with the default sizes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.predicates import quoted
from .rowid import ROW_ID

DEFAULT_BLOCK = 1 << 16
#: Consecutive blocks (or groups of blocks) over which one task carries values, and the levels of that: with these,
#: 2**48 rows.
FAN, LEVELS = 1 << 16, 2
#: Rows of a task, on average, where the session's shuffle partitions would hold more.
TASK_ROWS = 1 << 16


def _running(column: str, way: str, last: int, window=Window):
    """A running frame up to ``last``.  Both directions use one (unbounded
    preceding .. current), which Spark evaluates incrementally; "following"
    frames would be re-aggregated per row.  Backward is forward in reversed order."""
    order = F.col(column).asc() if way == "forward" else F.col(column).desc()
    return window.orderBy(order).rowsBetween(Window.unboundedPreceding, last)


def _edge(value: str, way: str, by: str, fields=()) -> Column:
    """The value of the last (forward) or first (backward) row that has one.  ``fields`` -- those of a struct, which are
    taken one by one: numbers are aggregated by hash, a struct by sorting all rows."""
    at = F.when(F.col(value).isNotNull(), F.col(by))
    pick, edge = (F.max_by, F.max) if way == "forward" else (F.min_by, F.min)
    if fields:
        return F.when(edge(at).isNotNull(), F.struct(*[pick(F.col(value)[f], at).alias(f) for f in fields]))
    return pick(F.col(value), at)


def _spread(d: DataFrame, key: str, rows: int) -> DataFrame:
    """``d`` by ``key`` over a task for every ``TASK_ROWS`` of its ``rows``, where the session's partitions would hold more."""
    tasks = -(-rows // TASK_ROWS)
    return d.repartition(tasks, key) if tasks > int(d.sparkSession.conf.get("spark.sql.shuffle.partitions")) else d


def _carried(summary: DataFrame, ways: dict[str, str], fan: int = FAN, levels: int = LEVELS) -> DataFrame:
    """``summary`` (``_key``, ``_s_<name>``) to (``_key``, ``_k_<name>``): the nearest value of another key
    before it (or after it, backward)."""
    t = summary.withColumn("_group", F.floor(F.col("_key") / F.lit(fan)).cast("bigint"))
    found = t.select("_key", "_group", *[F.last(F.col(f"_s_{n}"), ignorenulls=True).over(
        _running("_key", way, -1, Window.partitionBy("_group"))).alias(f"_k_{n}") for n, way in ways.items()])
    if levels == 1:  # one group is left
        return found.drop("_group")
    groups = t.groupBy("_group").agg(*[_edge(f"_s_{n}", way, "_key").alias(f"_s_{n}") for n, way in ways.items()])
    above = _carried(groups.withColumnRenamed("_group", "_key"), ways, fan, levels - 1)
    above = above.select(F.col("_key").alias("_group"), *[F.col(f"_k_{n}").alias(f"_a_{n}") for n in ways])
    return found.join(above, "_group").select("_key", *[F.coalesce(f"_k_{n}", f"_a_{n}").alias(f"_k_{n}") for n in ways])


def nearest_values(df: DataFrame, cands: dict[str, Column], direction: str | dict[str, str] = "forward",
                   id_col: str = ROW_ID, block: int = DEFAULT_BLOCK, fan: int = FAN, levels: int = LEVELS) -> DataFrame:
    """Add, for each ``name -> candidate``, the candidate value of the nearest
    row at or before (``forward``) / at or after (``backward``) the current row
    whose candidate is not null.  Candidates of both directions share one
    shuffle by block; ``direction`` then names each one's."""
    names = list(cands)
    ways = direction if isinstance(direction, dict) else dict.fromkeys(names, direction)
    d = df.withColumn("_blk", F.floor(F.col(id_col) / F.lit(block)).cast("bigint"))
    for n in names:
        d = d.withColumn(f"_c_{n}", cands[n])

    fields = {n: getattr(d.schema[f"_c_{n}"].dataType, "names", ()) for n in names}
    summary = d.groupBy("_blk").agg(*[_edge(f"_c_{n}", ways[n], id_col, fields[n]).alias(f"_s_{n}") for n in names])
    carry = _carried(summary.withColumnRenamed("_blk", "_key"), {n: ways[n] for n in names}, fan, levels).withColumnRenamed("_key", "_blk")
    d = _spread(d, "_blk", df.count()).join(carry, "_blk", "left")
    inside = Window.partitionBy("_blk")
    out = [F.col(quoted(c)) for c in df.columns]
    for n in names:
        local = F.last(F.col(f"_c_{n}"), ignorenulls=True).over(_running(id_col, ways[n], 0, inside))
        out.append(F.coalesce(local, F.col(f"_k_{n}")).alias(n))
    return d.select(*out)


def fill(df: DataFrame, targets: dict[str, Column], usable: dict[str, Column], method: str,
         id_col: str = ROW_ID, block: int = DEFAULT_BLOCK) -> DataFrame:
    """Replace target cells of each column with the previous / next usable
    value, or by linear interpolation between them (by row position; cells
    before the first or after the last usable value stay null).

    ``targets[c]`` -- which cells to replace; ``usable[c]`` -- which cells may
    serve as a source (missing and blank cells never do)."""
    cols = list(targets)
    if not cols:
        return df
    at = {c: i for i, c in enumerate(cols)}  # helper columns are numbered: names may hold dots
    col = {c: F.col(quoted(c)) for c in df.columns}
    if method in ("previous", "next"):
        cand = {f"_f_{at[c]}": F.when(usable[c], col[c]) for c in cols}
        d = nearest_values(df, cand, "forward" if method == "previous" else "backward", id_col, block)
        return d.select(*[F.when(targets[c], F.col(f"_f_{at[c]}")).otherwise(col[c]).alias(c) if c in at else col[c] for c in df.columns])
    if method == "linear":
        known = {c: F.when(usable[c], F.struct(F.col(id_col).alias("i"), col[c].cast("double").alias("v"))) for c in cols}
        ways = {f"_p_{at[c]}": "forward" for c in cols} | {f"_n_{at[c]}": "backward" for c in cols}
        d = nearest_values(df, {f"{k}_{at[c]}": known[c] for c in cols for k in ("_p", "_n")}, ways, id_col, block)
        sel = []
        for c in df.columns:
            if c not in at:
                sel.append(col[c])
                continue
            p, n = F.col(f"_p_{at[c]}"), F.col(f"_n_{at[c]}")
            span = (n["i"] - p["i"]).cast("double")
            interp = F.when(span == 0, p["v"]).otherwise(
                p["v"] + (n["v"] - p["v"]) * ((F.col(id_col) - p["i"]).cast("double") / span))
            sel.append(F.when(targets[c], interp).otherwise(col[c]).alias(c))
        return d.select(*sel)
    raise ValueError(method)
