"""Row identity (F1).

Spark rows have no position.  ``with_row_id`` gives consecutive 0-based ids
without pulling the data into one partition:

1. order (optional): range-partition on the keys, sort inside each partition;
2. write every row's partition and position to the shared checkpoint folder,
   once: counting and numbering then read the same rows, whatever plan each of
   them gets, and a lost executor changes nothing;
3. count rows per partition (one tiny row per partition), prefix-sum the
   counts into offsets (a window over at most ``#partitions`` rows) and join
   them back -- bounded by the partition count, so broadcasting is safe;
4. id = offset + position inside the partition
   (``monotonically_increasing_id`` minus the partition's high bits).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.predicates import quoted
from ..session import pinned

ROW_ID = "_row_id"


def _n_partitions(df: DataFrame, n: int | None) -> int:
    if n:
        return n
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))


def order_partitions(df: DataFrame, order_by, n_partitions: int | None = None) -> DataFrame:
    """Globally ordered partitions (range partitioning + local sort)."""
    keys = [F.col(c) if isinstance(c, str) else c for c in order_by]
    n = _n_partitions(df, n_partitions)
    return df.repartitionByRange(n, *keys).sortWithinPartitions(*keys)


def with_row_id(df: DataFrame, order_by=None, name: str = ROW_ID, n_partitions: int | None = None) -> DataFrame:
    """Append a consecutive 0-based ``bigint`` id.

    ``order_by`` -- list of columns giving the row order (ties get an arbitrary
    but consecutive numbering); without it the frame's own partition order is
    used (file order for a plain file scan).
    """
    cols = list(df.columns)
    if order_by:
        df = order_partitions(df, order_by, n_partitions)
    tagged = pinned(df.withColumn("_tc_pid", F.spark_partition_id())
                      .withColumn("_tc_pos", F.monotonically_increasing_id()
                                  - F.shiftleft(F.col("_tc_pid").cast("bigint"), 33)))
    counts = tagged.groupBy("_tc_pid").agg(F.count(F.lit(1)).alias("_tc_cnt"))
    before = Window.orderBy("_tc_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_tc_pid", F.coalesce(F.sum("_tc_cnt").over(before), F.lit(0)).alias("_tc_off"))
    out = tagged.join(F.broadcast(offsets), "_tc_pid")
    return out.select(*[F.col(quoted(c)) for c in cols], (F.col("_tc_off") + F.col("_tc_pos")).alias(name))


def ensure_row_id(df: DataFrame, order_by=None, name: str = ROW_ID) -> DataFrame:
    return df if name in df.columns else with_row_id(df, order_by, name)
