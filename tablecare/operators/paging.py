"""Deep pages of a sorted table.

``offset`` and ``limit`` on a sorted frame take offset + limit rows to one
task.  ``SortedPages`` sorts a table once, in parts of many rows (a task each),
and keeps it in the shared folder with every row's part and place in it.  Parts
are cut into ranges of consecutive places; the *rank directory* follows from
the number of rows of each part, all that comes to the driver.  A page then
names the places that hold it: only the row groups and Parquet pages with them
are read, and only the page's rows are sorted.
"""

from __future__ import annotations

import bisect
import itertools

from pyspark.sql import DataFrame, functions as F

from ..functions.predicates import quoted
from ..session import scratch_path
from .rowid import ROW_ID, ensure_row_id
from .table import total_pages

#: Rows of a part, about: small ranges share a task, whose result the driver keeps.
PART_ROWS = 1 << 19


class SortedPages:
    """Pages of ``df`` sorted by ``sort`` (nulls first in both directions), ties by ``tie``.

    ``tie`` -- columns that tell rows apart; without them the row id (added if
    the table has none).  ``rows_per_range`` -- rows that a range holds at most."""

    def __init__(self, df: DataFrame, sort: str | None, desc: bool = False, tie: list[str] | None = None,
                 rows_per_range: int = 1 << 20):
        spark = df.sparkSession
        self.columns = list(df.columns)
        df = df if tie else ensure_row_id(df)
        names = list(df.columns)
        tie = list(tie or [ROW_ID])
        at = {c: f"c{i}" for i, c in enumerate(names)}
        plain = df.toDF(*at.values())  # their own names may be anything
        first = ([F.col(at[sort]).desc_nulls_first() if desc else F.col(at[sort]).asc_nulls_first()] if sort else [])
        self._keys = [*first, *[F.col(at[c]).asc_nulls_first() for c in tie]]
        self._per_range = rows_per_range
        parts = max(1, -(-plain.count() // max(rows_per_range, PART_ROWS)))
        sorted_ = plain.repartitionByRange(parts, *self._keys).sortWithinPartitions(*self._keys)
        tagged = (sorted_.withColumn("_part", F.spark_partition_id())
                  .withColumn("_place", F.monotonically_increasing_id() - F.shiftleft(F.col("_part").cast("bigint"), 33)))
        path = scratch_path(spark, "sorted")
        tagged.write.parquet(path)
        self._at, self._stored = at, spark.read.schema(tagged.schema).parquet(path)
        counts = self._stored.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).orderBy("_part").collect()  # a row a part
        self._parts = [r["_part"] for r in counts]
        self._ends = list(itertools.accumulate(r["n"] for r in counts))

    @property
    def rows(self) -> int:
        return self._ends[-1] if self._ends else 0

    def directory(self) -> list[tuple[int, int, int]]:
        """(range, rank of its first row, rank after its last)."""
        cuts = [(at, min(at + self._per_range, end)) for start, end in zip([0, *self._ends[:-1]], self._ends) for at in range(start, end, self._per_range)]
        return [(i, *cut) for i, cut in enumerate(cuts)]

    def total_pages(self, limit: int) -> int:
        return total_pages(self.rows, limit)

    def page(self, page_no: int = 1, limit: int = 100) -> DataFrame:
        """Rows ``(page_no - 1) * limit .. page_no * limit`` in order; ``limit <= 0`` gives all."""
        start = max(0, (page_no - 1) * limit) if limit > 0 else 0
        end = start + limit if limit > 0 else self.rows
        rows = self._stored
        if start > 0 or end < self.rows:
            first, last = bisect.bisect_right(self._ends, start), bisect.bisect_left(self._ends, min(end, self.rows))
            if first >= len(self._ends):
                rows = rows.where(F.lit(False))
            else:
                part, place, begins = F.col("_part"), F.col("_place"), [0, *self._ends]
                low, high = self._parts[first], self._parts[last]
                from_, to = place >= start - begins[first], place < end - begins[last]
                rows = rows.where((part == low) & from_ & to if first == last else
                                  (part == low) & from_ | (part > low) & (part < high) | (part == high) & to)
        rows = rows.orderBy("_part", "_place")
        return rows.select(*[F.col(self._at[c]).alias(c) for c in self.columns])
