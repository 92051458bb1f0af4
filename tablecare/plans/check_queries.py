"""Registered queries of branches that other queries pass by: previews with
scores, domain KPIs, refreshed charts, number texts, outlier previews and more."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import charts as C, dashboard as D
from ..operators.analysis import Analysis, outlier_preview
from ..operators.classify import planner_id_columns
from ..operators.clean import clean
from ..operators.profile import profile
from ..operators.rowid import ROW_ID, with_row_id
from . import sqlgen as S
from .clean_queries import TYPED, emp, miss
from .quality import column_table, duplicate_value_columns, preview, quality_report
from .quality_queries import DIRTY_NUMERIC, outlier_pred_sql, outlier_rules_sql
from .report_queries import SQL_QUALITY_SCORES, dirty_columns_sql
from .scale_queries import _chart_rows
from .views import DIRTY_ORDER, DIRTY_ORDERS_SQL, dirty_orders, table


# ------------------------------------------------------- previews with scores (J6) ---
def _preview(issue, cols, method, custom=None):
    def run(spark, sf):
        return preview(Analysis(dirty_orders(spark, sf)), issue, cols, method, custom, order_by=list(DIRTY_ORDER))["metrics"]
    return run


def _scores_after(select: str) -> str:
    """The overall score of the dirty view after ``select`` (of the view ``before_step``)."""
    after = f"WITH before_step AS ({DIRTY_ORDERS_SQL}) {select}"
    return "(SELECT overall FROM (" + SQL_QUALITY_SCORES.replace(DIRTY_ORDERS_SQL, after) + "))"


def _preview_sql(removed: str, changed: str, after: str) -> str:
    return TYPED + f"""
SELECT '' AS dropped_columns, {removed} AS rows_removed, {changed} AS values_changed, count(*) - {removed} AS rows_remaining,
  (SELECT overall FROM ({SQL_QUALITY_SCORES})) AS current_score, {_scores_after(after)} AS estimated_score,
  round(greatest(0, {_scores_after(after)} - (SELECT overall FROM ({SQL_QUALITY_SCORES}))), 2) AS improvement FROM typed"""


_RAW_EMPTY = S.empty("priority", "text")
_RAW_MISSING = S.missing("priority", "text")
SQL_PREVIEW_ROWS = _preview_sql(f"count_if({emp('priority')})", "CAST(0 AS BIGINT)", f"SELECT * FROM before_step WHERE NOT {_RAW_EMPTY}")
SQL_PREVIEW_CELLS = _preview_sql("CAST(0 AS BIGINT)", f"count_if({miss('priority')})",
                                 f"SELECT row_key, CASE WHEN {_RAW_MISSING} THEN 'unknown' ELSE priority END AS priority, price_text, price, email, "
                                 "status, ordered_at, copy_no FROM before_step")


def q_preview_columns(spark, sf):
    """A step that drops columns changes all their cells."""
    return _preview("Constant Columns", ["email", "status"], "Drop Column")(spark, sf).select(
        "dropped_columns", "rows_removed", "values_changed", "rows_remaining", "current_score")


SQL_PREVIEW_COLUMNS = TYPED + f"""
SELECT 'email,status' AS dropped_columns, CAST(0 AS BIGINT) AS rows_removed, 2 * count(*) AS values_changed, count(*) AS rows_remaining,
  (SELECT overall FROM ({SQL_QUALITY_SCORES})) AS current_score FROM typed"""


def q_preview_samples(spark, sf):
    """The first changed rows, before and after."""
    p = preview(Analysis(dirty_orders(spark, sf)), "Missing Values", ["priority"], "Replace with Custom Value", "unknown", order_by=list(DIRTY_ORDER))
    b = p["before"].select(ROW_ID, "row_key", F.col("priority").alias("before"))
    return b.join(p["after"].select(ROW_ID, F.col("priority").alias("after")), ROW_ID)


SQL_PREVIEW_SAMPLES = TYPED + f"""
SELECT rid AS _row_id, row_key, priority AS before, 'unknown' AS after FROM typed WHERE {miss('priority')} ORDER BY rid LIMIT 5"""


# ------------------------------------------------------------- domain KPIs (E31) ---
def q_kpis_movies(spark, sf):
    """E31 Movies: titles by type, mean year."""
    o = table(spark, sf, "orders").select(F.when(F.col("o_orderkey") % 3 == 0, "TV Show").otherwise("Movie").alias("type"),
                                          F.year("o_orderdate").alias("release_year"))
    return D.kpis(o, {"type": "Categorical_LowCard", "release_year": "Numeric"}, "Movies")


SQL_KPIS_MOVIES = """WITH o AS (SELECT CASE WHEN o_orderkey % 3 = 0 THEN 'TV Show' ELSE 'Movie' END AS type, year(o_orderdate) AS release_year FROM orders)
SELECT 'Total Movies' AS title, CAST(count(*) AS DOUBLE) AS value, 'count' AS type, CAST(NULL AS VARCHAR) AS "column", 'number' AS format FROM o
UNION ALL SELECT 'Total Movies', CAST(count_if(contains(lower(type), 'movie')) AS DOUBLE), 'count', NULL, 'number' FROM o
UNION ALL SELECT 'TV Shows', CAST(count_if(contains(lower(type), 'tv')) AS DOUBLE), 'count', NULL, 'number' FROM o
UNION ALL SELECT 'Avg Release Year', round(avg(release_year), 0), 'average', NULL, 'number' FROM o
UNION ALL SELECT 'Average release_year', round(avg(release_year), 2), 'average', 'release_year', 'number' FROM o"""


def q_kpis_retail(spark, sf):
    """E31 Retail: revenue, profit, products."""
    li = table(spark, sf, "lineitem").select(F.col("l_extendedprice").alias("revenue"), (F.col("l_extendedprice") * F.col("l_discount")).alias("profit"),
                                             F.col("l_partkey").alias("product"), F.col("l_quantity").alias("units"))
    return D.kpis(li, {"revenue": "Numeric", "profit": "Numeric", "units": "Numeric"}, "Retail")


SQL_KPIS_RETAIL = """SELECT 'Total Retail' AS title, CAST(count(*) AS DOUBLE) AS value, 'count' AS type, CAST(NULL AS VARCHAR) AS "column", 'number' AS format FROM lineitem
UNION ALL SELECT 'Total Revenue', round(sum(l_extendedprice), 2), 'sum', NULL, 'currency' FROM lineitem
UNION ALL SELECT 'Total Profit', round(sum(l_extendedprice * l_discount), 2), 'sum', NULL, 'currency' FROM lineitem
UNION ALL SELECT 'Unique Products', CAST(count(DISTINCT l_partkey) AS DOUBLE), 'count', NULL, 'number' FROM lineitem
UNION ALL SELECT 'Average units', round(avg(l_quantity), 2), 'average', 'units', 'number' FROM lineitem"""


def q_kpis_survey(spark, sf):
    """E31 Survey: mean satisfaction."""
    c = table(spark, sf, "customer").select((F.col("c_custkey") % 5 + 1).alias("satisfaction"), F.col("c_acctbal").alias("balance"))
    return D.kpis(c, {"satisfaction": "Numeric", "balance": "Numeric"}, "Survey")


SQL_KPIS_SURVEY = """SELECT 'Total Survey' AS title, CAST(count(*) AS DOUBLE) AS value, 'count' AS type, CAST(NULL AS VARCHAR) AS "column", 'number' AS format FROM customer
UNION ALL SELECT 'Avg Satisfaction', round(avg(c_custkey % 5 + 1), 1), 'average', NULL, 'number' FROM customer
UNION ALL SELECT 'Average balance', round(avg(c_acctbal), 2), 'average', 'balance', 'number' FROM customer"""


# ------------------------------------------------------- charts: B17, E19, E25, J13 ---
def q_keyword_counts(spark, sf):
    """Cells that hold a keyword, in any case."""
    d = dirty_orders(spark, sf)
    return d.agg(C.count_matching(d, "priority", "URGENT").alias("urgent"), C.count_matching(d, "email", "user1").alias("user1"),
                 C.count_matching(d, "row_key", "7").alias("sevens"))


SQL_KEYWORDS = TYPED + """
SELECT count_if(contains(lower(priority), 'urgent')) AS urgent, count_if(contains(lower(email), 'user1')) AS user1,
  count_if(contains(CAST(row_key AS VARCHAR), '7')) AS sevens FROM typed"""


def q_sum_by_date_100(spark, sf):
    """Totals of the last hundred dates."""
    return C.sum_by_date(table(spark, sf, "orders"), "o_orderdate", "o_totalprice", 100).select("o_orderdate", F.round("o_totalprice", 2).alias("total"))


SQL_DATE_100 = "SELECT o_orderdate, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_orderdate ORDER BY o_orderdate DESC LIMIT 100"


def q_insight_correlation(spark, sf):
    """Two numbers that move together."""
    o = table(spark, sf, "orders").select("o_totalprice", (F.col("o_totalprice") * -2 + F.col("o_custkey")).alias("rest"))
    found = D.insights(o, {"o_totalprice": "Numeric", "rest": "Numeric"})
    return found.where("kind IN ('correlation', 'records')").select("kind", "column", "value")


SQL_CORRELATION = """SELECT 'records' AS kind, CAST(NULL AS VARCHAR) AS "column", CAST(count(*) AS DOUBLE) AS value FROM orders
UNION ALL SELECT 'correlation', 'o_totalprice,rest', round(corr(o_totalprice, o_totalprice * -2 + o_custkey), 2) FROM orders"""

REFRESHED = [("pie", "o_orderstatus", "count"), ("line", "o_orderdate", "o_totalprice"), ("area", "o_orderpriority", "o_totalprice"),
             ("histogram", "o_totalprice", "count"), ("bar", "gone", "count")]


def q_refreshed_charts(spark, sf):
    """Earlier charts over a table that has changed since."""
    o = table(spark, sf, "orders").where(F.col("o_totalprice") > 1000)
    return _chart_rows([(kind, x, data) for kind, x, _, data in D.refresh_charts(o, REFRESHED)])


SQL_REFRESHED = """WITH f AS (SELECT * FROM orders WHERE o_totalprice > 1000), b AS (SELECT min(o_totalprice) AS mn, max(o_totalprice) AS mx FROM f),
  dates AS (SELECT o_orderdate, sum(o_totalprice) AS s FROM f GROUP BY 1 ORDER BY 1 DESC LIMIT 100),
  bins AS (SELECT least(10, greatest(1, CAST(floor((o_totalprice - mn) / ((mx - mn) / 10)) AS INTEGER) + 1)) AS bin, count(*) AS n FROM f, b GROUP BY 1)
SELECT '0 pie' AS chart, o_orderstatus AS k, CAST(NULL AS VARCHAR) AS k2, CAST(count(*) AS DOUBLE) AS v FROM f GROUP BY 2
UNION ALL SELECT '1 line', strftime(o_orderdate, '%Y-%m-%d'), NULL, round(s, 2) FROM dates
UNION ALL SELECT '2 area', o_orderpriority, NULL, round(sum(o_totalprice), 2) FROM f GROUP BY 2
UNION ALL SELECT '3 histogram', CAST(u.bin AS VARCHAR), NULL, coalesce(n, 0) FROM (SELECT unnest(range(1, 11)) AS bin) u LEFT JOIN bins USING (bin)"""


# --------------------------------------------------- reports: C4, E12, E13, J4 ---
def q_planner_ids(spark, sf):
    """C4: columns that are identifiers to the planner, by name and by their values."""
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("order_uuid"), (F.col("o_custkey") % 7).alias("cust_hash"),
                                          F.col("o_orderkey").alias("plain"), F.col("o_orderstatus").alias("guid_kind"))
    return planner_id_columns(profile(o, with_quantiles=False))


SQL_PLANNER_IDS = """SELECT c AS "column" FROM (
  SELECT 'order_uuid' AS c, count(DISTINCT o_orderkey) AS d, count(*) AS n FROM orders
  UNION ALL SELECT 'cust_hash', count(DISTINCT o_custkey % 7), count(*) FROM orders
  UNION ALL SELECT 'guid_kind', count(DISTINCT o_orderstatus), count(*) FROM orders) WHERE d > 0.9 * n"""


def q_repeated_value_columns(spark, sf):
    """Active columns whose values repeat, most repeated cells first."""
    return duplicate_value_columns(column_table(Analysis(dirty_orders(spark, sf))), 10)


def _repeated_sql() -> str:
    parts = []
    for c in ("row_key", "priority", "price_text", "price", "email", "status", "ordered_at", "copy_no"):
        parts.append(f"SELECT {S.lit(c)} AS \"column\", sum(n) FILTER (WHERE n > 1) AS dup_cells FROM (SELECT count(*) AS n FROM typed GROUP BY {S.q(c)})")
    return dirty_columns_sql() + ", reps AS (" + "\nUNION ALL\n".join(parts) + """)
SELECT cols."column", CAST(dup_cells AS BIGINT) AS dup_cells, round(dup_cells / rows * 100, 2) AS dup_pct
FROM reps JOIN cols ON cols."column" = reps."column" WHERE active AND dup_cells > 0 ORDER BY dup_cells DESC, position LIMIT 10"""


def q_outlier_preview(spark, sf):
    """The first outliers of a column."""
    a = Analysis(with_row_id(dirty_orders(spark, sf), list(DIRTY_ORDER)))
    return outlier_preview(a, "price").select(ROW_ID, F.round("value", 4).alias("value"))


SQL_OUTLIER_PREVIEW = TYPED + f""", rules AS ({outlier_rules_sql('typed', {c: S.q(c) for c in DIRTY_NUMERIC})})
SELECT rid AS _row_id, round(price, 4) AS value FROM typed JOIN rules r ON r.col = 'price'
WHERE coalesce({outlier_pred_sql('price', 'r')}, false) ORDER BY rid LIMIT 5"""


def q_report_class_counts(spark, sf):
    """The report's columns by class, and its invalid cells."""
    report = quality_report(Analysis(dirty_orders(spark, sf)))
    return report["class_counts"].select(F.col("class").alias("what"), F.col("columns").alias("n")).unionByName(
        report["invalid"].select(F.concat(F.lit("invalid "), "column").alias("what"), F.col("invalid").alias("n")))


SQL_CLASS_COUNTS = dirty_columns_sql() + """
SELECT class AS what, count(*) AS n FROM cols WHERE active GROUP BY class
UNION ALL SELECT 'invalid ' || "column", invalid FROM cols WHERE invalid > 0"""


# ------------------------------------------------------------- cleaning: I20, I24 ---
def q_keep_last_whole(spark, sf):
    """Of rows equal but for blanks around their texts, the last one stays as it is."""
    d = dirty_orders(spark, sf).withColumn("status", F.when(F.col("copy_no") == 1, F.concat(F.lit(" "), "status", F.lit(" "))).otherwise(F.col("status")))
    d = with_row_id(d, list(DIRTY_ORDER)).drop("copy_no", "price", "price_text", "ordered_at")
    return clean(Analysis(d), "Duplicate Rows", ["all"], "Keep Last").select(ROW_ID, "row_key", "priority", "status")


SQL_KEEP_LAST = TYPED + """
SELECT rid AS _row_id, row_key, priority, status FROM (
  SELECT rid, row_key, priority, CASE WHEN copy_no = 1 THEN ' ' || status || ' ' ELSE status END AS status,
    row_number() OVER (PARTITION BY row_key ORDER BY rid DESC) AS k FROM typed) WHERE k = 1"""

_CODES = {0: "12", 1: "+3.50", 2: "abc", 3: "1e3", 4: " 7", 5: "", 6: ".5", 7: "4.", 8: "-2E-1", 9: "n/a"}


def q_clean_number_texts(spark, sf):
    """Texts in any way of writing a number become numbers, others null."""
    code = F.element_at(F.create_map(*[x for k, v in _CODES.items() for x in (F.lit(k), F.lit(v))]), (F.col("o_orderkey") % 10).cast("int"))
    o = table(spark, sf, "orders").select("o_orderkey", code.alias("code"))
    return clean(Analysis(o), "Invalid Data Types", ["code"], "Convert to Numeric").select("o_orderkey", "code")


SQL_NUMBER_TEXTS = "SELECT o_orderkey, CASE WHEN regexp_matches(code, '^[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?$') THEN CAST(code AS DOUBLE) END AS code FROM (" \
    "SELECT o_orderkey, CASE o_orderkey % 10 " + " ".join(f"WHEN {k} THEN {S.lit(v)}" for k, v in _CODES.items()) + " END AS code FROM orders)"


QUERIES = {
    "preview_rows": (_preview("Empty Cells", ["priority"], "Remove Rows"), SQL_PREVIEW_ROWS),
    "preview_cells": (_preview("Missing Values", ["priority"], "Replace with Custom Value", "unknown"), SQL_PREVIEW_CELLS),
    "preview_columns": (q_preview_columns, SQL_PREVIEW_COLUMNS),
    "preview_samples": (q_preview_samples, SQL_PREVIEW_SAMPLES),
    "kpis_movies": (q_kpis_movies, SQL_KPIS_MOVIES),
    "kpis_retail": (q_kpis_retail, SQL_KPIS_RETAIL),
    "kpis_survey": (q_kpis_survey, SQL_KPIS_SURVEY),
    "keyword_counts": (q_keyword_counts, SQL_KEYWORDS),
    "sum_by_date_100": (q_sum_by_date_100, SQL_DATE_100),
    "insight_correlation": (q_insight_correlation, SQL_CORRELATION),
    "refreshed_charts": (q_refreshed_charts, SQL_REFRESHED),
    "planner_ids": (q_planner_ids, SQL_PLANNER_IDS),
    "repeated_value_columns": (q_repeated_value_columns, _repeated_sql()),
    "outlier_preview": (q_outlier_preview, SQL_OUTLIER_PREVIEW),
    "report_class_counts": (q_report_class_counts, SQL_CLASS_COUNTS),
    "keep_last_whole": (q_keep_last_whole, SQL_KEEP_LAST),
    "clean_number_texts": (q_clean_number_texts, SQL_NUMBER_TEXTS),
}
