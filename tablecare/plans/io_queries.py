"""Registered queries for scans, sinks and view helpers.

Round trips write the given table into a fresh folder under the shared
checkpoint folder and read it back with the text readers.
"""

from __future__ import annotations


from pyspark.sql import functions as F

from ..operators.dashboard import auto_dashboard
from ..operators.infer import type_evidence
from ..operators.rowid import ROW_ID, with_row_id
from ..operators.table import head, page, search, sort_as_text, sort_by
from ..session import scratch_path
from ..sources.io import read_json, read_table, table_summary, write_csv
from . import sqlgen as S
from .views import table


def _scratch(spark, kind, suffix=""):
    return scratch_path(spark, f"io-{kind}", suffix)


def q_csv_roundtrip(spark, sf):
    """A7 -> A1/A5 -> B5: write orders as CSV, read it back all-string, decide promotion."""
    path = _scratch(spark, "csv", ".csv")
    write_csv(table(spark, sf, "orders"), path)
    back = read_table(spark, path)
    ev = type_evidence(back)
    return ev.select("column", "valid", "numeric_valid", "promoted")


def _csv_sql():
    parts = []
    for c in ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"):
        x = f"CAST({c} AS VARCHAR)"
        v = S.valid(x, "text")
        parts.append(f"SELECT {S.lit(c)} AS \"column\", count_if({v}) AS valid, "
                     f"count_if({v} AND {S.matches(x, 'numeric')}) AS numeric_valid, "
                     f"coalesce(count_if({v} AND {S.matches(x, 'numeric')}) / nullif(count_if({v}), 0) >= 0.9, false) "
                     f"AS promoted FROM orders")
    return "\nUNION ALL\n".join(parts)


def q_json_roundtrip(spark, sf):
    """A3: write lineitem as JSON lines, read back with inferred types."""
    path = _scratch(spark, "json")
    table(spark, sf, "lineitem").write.mode("overwrite").json(path)
    back = read_json(spark, path, multiLine="false")
    return back.agg(F.count(F.lit(1)).alias("rows"), F.round(F.sum("l_extendedprice"), 2).alias("sum_price"),
                    F.count_distinct("l_orderkey").alias("orders"))


SQL_JSON = ("SELECT count(*) AS rows, round(sum(l_extendedprice), 2) AS sum_price, "
            "count(DISTINCT l_orderkey) AS orders FROM lineitem")


def q_json_array(spark, sf):
    """A3: customers as JSON arrays, one for each nation, read back without being told so."""
    path = _scratch(spark, "array")
    rows = table(spark, sf, "customer").groupBy("c_nationkey").agg(F.to_json(F.collect_list(F.struct("c_custkey", "c_acctbal"))).alias("value")).select("value")
    rows.write.mode("overwrite").option("maxRecordsPerFile", 1).text(path)
    return read_json(spark, path).agg(F.count(F.lit(1)).alias("rows"), F.sum("c_custkey").alias("keys"))


SQL_JSON_ARRAY = "SELECT count(*) AS rows, CAST(sum(c_custkey) AS BIGINT) AS keys FROM customer"


def q_table_overview(spark, sf):
    """Rows and columns of a table (bytes come from file metadata)."""
    return table_summary(spark.read.parquet(f"{sf.rstrip('/')}/customer.parquet")).select("rows", "cols")


SQL_OVERVIEW = "SELECT count(*) AS rows, 5 AS cols FROM customer"


def q_search_all_types(spark, sf):
    """Literal search over every column as text."""
    o = with_row_id(table(spark, sf, "orders"), ["o_orderkey"])
    return page(sort_by(search(o, "1998-1", all_types=True), None), 1, 100).select(ROW_ID, "o_orderkey")


SQL_SEARCH_ALL = """SELECT rid AS _row_id, o_orderkey FROM (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS rid FROM orders)
WHERE contains(lower(CAST(o_orderkey AS VARCHAR)), '1998-1') OR contains(lower(CAST(o_custkey AS VARCHAR)), '1998-1')
   OR contains(lower(o_orderstatus), '1998-1') OR contains(lower(CAST(o_totalprice AS VARCHAR)), '1998-1')
   OR contains(lower(CAST(o_orderdate AS VARCHAR)), '1998-1') OR contains(lower(o_orderpriority), '1998-1')
ORDER BY rid LIMIT 100"""


def q_sort_as_text(spark, sf):
    """Case-insensitive text sort, nulls as blank, 10 rows a page (page 3)."""
    p = with_row_id(table(spark, sf, "part"), ["p_partkey"])
    return page(sort_as_text(p, "p_name", desc=True), 3, 10).select(ROW_ID, "p_name")


SQL_SORT_TEXT = """SELECT rid AS _row_id, p_name FROM (SELECT *, row_number() OVER (ORDER BY p_partkey) - 1 AS rid FROM part)
ORDER BY lower(coalesce(p_name, '')) DESC, rid LIMIT 10 OFFSET 20"""


def q_head_rows(spark, sf):
    """First 5 rows by row id, first 10 columns."""
    li = with_row_id(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"])
    return head(li, 5, 10)


SQL_HEAD = """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax,
  l_returnflag, l_linestatus FROM lineitem ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey LIMIT 5"""


def q_auto_dashboard(spark, sf):
    """The charts picked for orders, by score."""
    charts = auto_dashboard(table(spark, sf, "orders"))
    rows = [(i + 1, t, title, float(score)) for i, (t, title, score, _) in enumerate(charts)]
    return spark.createDataFrame(rows, "rank int, type string, title string, score double")


SQL_AUTO_DASH = """WITH p AS (
  SELECT 'o_orderstatus' AS c, count(DISTINCT o_orderstatus) + CAST(count(*) > count(o_orderstatus) AS BIGINT) AS uc FROM orders
  UNION ALL SELECT 'o_orderpriority', count(DISTINCT o_orderpriority) + CAST(count(*) > count(o_orderpriority) AS BIGINT) FROM orders),
cand AS (
  SELECT * FROM (SELECT 1 AS seq, 'bar' AS type, 'Top ' || c || ' by Count' AS title, 10 - uc / 5 AS score FROM p
                 WHERE uc BETWEEN 2 AND 20 ORDER BY uc LIMIT 3)
  UNION ALL SELECT * FROM (SELECT 2, 'pie', c || ' Distribution', 9.0 FROM p WHERE uc BETWEEN 2 AND 8
                 ORDER BY CASE c WHEN 'o_orderstatus' THEN 0 ELSE 1 END LIMIT 1)
  UNION ALL SELECT 3, 'bar', 'Distribution of o_totalprice', 8.5 FROM orders HAVING count(o_totalprice) > 10
                 AND min(o_totalprice) <> max(o_totalprice)
  UNION ALL SELECT 4, 'line', 'o_totalprice Over Time (o_orderdate)', 9.5
  UNION ALL SELECT 5, 'area', 'Total o_totalprice by o_orderstatus', 8.8 FROM p WHERE c = 'o_orderstatus' AND uc <= 15)
SELECT CAST(row_number() OVER (ORDER BY score DESC, seq, uc_order) AS INTEGER) AS rank, type, title, CAST(score AS DOUBLE) AS score
FROM (SELECT *, row_number() OVER () AS uc_order FROM cand)"""


QUERIES = {
    "json_array": (q_json_array, SQL_JSON_ARRAY),
    "csv_roundtrip": (q_csv_roundtrip, _csv_sql()),
    "json_roundtrip": (q_json_roundtrip, SQL_JSON),
    "table_overview": (q_table_overview, SQL_OVERVIEW),
    "search_all_types": (q_search_all_types, SQL_SEARCH_ALL),
    "sort_as_text": (q_sort_as_text, SQL_SORT_TEXT),
    "head_rows": (q_head_rows, SQL_HEAD),
    "auto_dashboard": (q_auto_dashboard, SQL_AUTO_DASH),
}


def q_tsv_roundtrip(spark, sf):
    """A2: customer written as TSV, read back all-string, promotion decided."""
    path = _scratch(spark, "tsv", ".tsv")
    write_csv(table(spark, sf, "customer"), path, sep="\t")
    return type_evidence(read_table(spark, path)).select("column", "valid", "numeric_valid", "promoted")


def _tsv_sql():
    parts = []
    for c in ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"):
        x = f"CAST({c} AS VARCHAR)"
        v = S.valid(x, "text")
        parts.append(f"SELECT {S.lit(c)} AS \"column\", count_if({v}) AS valid, "
                     f"count_if({v} AND {S.matches(x, 'numeric')}) AS numeric_valid, "
                     f"coalesce(count_if({v} AND {S.matches(x, 'numeric')}) / nullif(count_if({v}), 0) >= 0.9, false) "
                     f"AS promoted FROM customer")
    return "\nUNION ALL\n".join(parts)


def q_named_dataset(spark, sf):
    """A4: a dataset of named tables; the first name is the default."""
    from ..sources.io import default_name, load_dataset
    names = ("orders", "customer", "nation")
    ds = load_dataset(spark, {n: f"{sf.rstrip('/')}/{n}.parquet" for n in names})
    first = default_name(ds)
    parts = [df.agg(F.lit(n).alias("name"), F.count(F.lit(1)).alias("rows"), F.lit(n == first).alias("is_default"))
             for n, df in ds.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


SQL_NAMED = ("SELECT 'orders' AS name, count(*) AS rows, true AS is_default FROM orders UNION ALL "
             "SELECT 'customer', count(*), false FROM customer UNION ALL SELECT 'nation', count(*), false FROM nation")


def q_quoted_export(spark, sf):
    """The searched, sorted view exported with every value quoted; read back."""
    from ..sources.io import read_csv
    path = _scratch(spark, "export", ".csv")
    view = sort_by(search(table(spark, sf, "orders"), "urgent"), "o_orderkey", tie=None)
    write_csv(view, path, quote_all=True)
    lines = spark.read.text(path)
    unquoted = lines.where(~F.col("value").startswith('"')).agg(F.count(F.lit(1))).scalar()
    back = read_csv(spark, path)
    return back.agg(F.count(F.lit(1)).alias("rows"), F.sum(F.col("o_orderkey").cast("bigint")).alias("key_sum"),
                    unquoted.alias("unquoted_lines"))


SQL_QUOTED = ("SELECT count(*) AS rows, CAST(sum(o_orderkey) AS BIGINT) AS key_sum, CAST(0 AS BIGINT) AS unquoted_lines "
              "FROM orders "
              "WHERE contains(lower(o_orderstatus), 'urgent') OR contains(lower(o_orderpriority), 'urgent')")

QUERIES.update({
    "tsv_roundtrip": (q_tsv_roundtrip, _tsv_sql()),
    "named_dataset": (q_named_dataset, SQL_NAMED),
    "quoted_export": (q_quoted_export, SQL_QUOTED),
})
