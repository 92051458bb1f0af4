"""Input views shared by the registered queries and their SQL oracle.

``DIRTY_ORDERS_SQL`` derives a table with nulls, sentinels, blanks, case and
padding variants, unparsable numbers, outliers, invalid e-mails and repeated
rows from ``orders``; the same text runs in Spark and in DuckDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

DIRTY_ORDERS_SQL = """WITH base AS (
  SELECT o_orderkey AS row_key,
    CASE WHEN o_orderkey % 11 = 0 THEN NULL
         WHEN o_orderkey % 13 = 0 THEN 'N/A'
         WHEN o_orderkey % 17 = 0 THEN '   '
         WHEN o_orderkey % 19 = 0 THEN lower(o_orderpriority)
         WHEN o_orderkey % 23 = 0 THEN concat(' ', o_orderpriority, ' ')
         ELSE o_orderpriority END AS priority,
    CASE WHEN o_orderkey % 7 = 0 THEN NULL
         WHEN o_orderkey % 29 = 0 THEN 'null'
         WHEN o_orderkey % 31 = 0 THEN ''
         ELSE CAST(CAST(o_totalprice AS DECIMAL(12,2)) AS STRING) END AS price_text,
    CASE WHEN o_orderkey % 10 = 3 THEN NULL
         WHEN o_orderkey % 97 = 0 THEN o_totalprice * 20
         ELSE o_totalprice END AS price,
    CASE WHEN o_orderkey % 9 = 0 THEN 'not-an-email'
         ELSE concat('user', CAST(o_custkey AS STRING), '@example.com') END AS email,
    o_orderstatus AS status,
    o_orderdate AS ordered_at
  FROM orders)
SELECT *, 0 AS copy_no FROM base
UNION ALL
SELECT *, 1 AS copy_no FROM base WHERE row_key % 50 = 0"""

DIRTY_ORDER = ("row_key", "copy_no")
DIRTY_KEYS = ("row_key", "priority", "price_text", "price", "email", "status", "ordered_at")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table.  The test files hold one row group each, so the scan is a
    single task; ask for at least the session's parallelism (a no-op for
    inputs that already split into that many partitions)."""
    from ..sources.io import read_parquet
    par = spark.sparkContext.defaultParallelism
    return read_parquet(spark, f"{sf_dir.rstrip('/')}/{name}.parquet", min_partitions=par)


def register(spark: SparkSession, sf_dir: str, names=("orders",)) -> None:
    for n in names:
        table(spark, sf_dir, n).createOrReplaceTempView(n)


def dirty_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    register(spark, sf_dir, ("orders",))
    return spark.sql(DIRTY_ORDERS_SQL)


def dirty_cte(select_sql: str) -> str:
    """Wrap an oracle query so that ``dirty_orders`` is defined for DuckDB."""
    return f"WITH dirty_orders AS ({DIRTY_ORDERS_SQL})\n{select_sql}"
