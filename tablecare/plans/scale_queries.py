"""Registered queries of the operators that bound what they shuffle: modes by
heavy hitters, quantiles by brackets, profiles kept per file, row samples, deep
pages, kept versions, and a dashboard's totals from one aggregate."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.charts import corr_matrix
from ..operators.dashboard import cube_of, dashboard_charts, filtered_dashboard, kpis
from ..operators.paging import SortedPages
from ..operators.profile import modes
from ..operators.quantiles import order_stats
from ..operators.table import hash_sample
from ..session import scratch_path
from . import sqlgen as S
from .clean_queries import shape
from .dashboard_queries import QUERIES as DASHBOARD_QUERIES, RECIPE
from .profile_store import ProfileStore, files_under
from .recipe import VersionStore
from .search_index import SearchIndex
from .views import dirty_orders, table


# -------------------------------------------------------------- modes (E3, E7) ---
MODE_COLUMNS = ("l_orderkey", "l_quantity", "l_extendedprice", "l_returnflag", "l_linestatus", "l_comment_like")


def _with_text(df):
    """``lineitem`` with a text column of many values, some of them frequent."""
    return df.withColumn("l_comment_like", F.when(F.col("l_linenumber") < 3, F.concat(F.lit("part "), F.col("l_partkey").cast("string")))
                         .when(F.col("l_linenumber") == 3, F.lit(" n/a ")).otherwise(F.lit("standard")))


def q_column_modes(spark, sf):
    """The mode and its count of hot, flat and mixed columns."""
    found = modes(_with_text(table(spark, sf, "lineitem")), list(MODE_COLUMNS))
    rows = [(c, t, n, k) for c, (t, n, k) in found.items()]
    return spark.createDataFrame(rows, "column string, mode string, mode_num double, n bigint")


def _mode_sql(c: str) -> str:
    text = c in ("l_returnflag", "l_linestatus", "l_comment_like")
    x = {"l_comment_like": "CASE WHEN l_linenumber < 3 THEN 'part ' || CAST(l_partkey AS VARCHAR) WHEN l_linenumber = 3 THEN ' n/a ' "
                           "ELSE 'standard' END"}.get(c, S.q(c) if text else f"CAST({S.q(c)} AS DOUBLE)")
    keep = "x IS NOT NULL" + (" AND trim(x) <> '' AND lower(trim(x)) <> 'n/a'" if text else "")
    return (f"(SELECT {S.lit(c)} AS \"column\", {'x' if text else 'CAST(NULL AS VARCHAR)'} AS mode, "
            f"{'CAST(NULL AS DOUBLE)' if text else 'x'} AS mode_num, count(*) AS n FROM (SELECT {x} AS x FROM lineitem) WHERE {keep} "
            "GROUP BY x ORDER BY n DESC, x LIMIT 1)")


SQL_MODES = "\nUNION ALL\n".join(_mode_sql(c) for c in MODE_COLUMNS)


# ---------------------------------------------------- quantiles by group (E5, E29) ---
QS = {"p01": (0.01, "nearest"), "q1": (0.25, "floor_n"), "median": (0.5, "linear"), "p99": (0.99, "nearest")}


def q_quantiles_by_group(spark, sf):
    """Exact order statistics per group, from sketches and what lies inside their brackets."""
    li = table(spark, sf, "lineitem").select("l_returnflag", "l_linestatus", "l_extendedprice")
    st = order_stats(li, ["l_returnflag", "l_linestatus"], "l_extendedprice", QS)
    return st.select("l_returnflag", "l_linestatus", F.col("n").cast("bigint").alias("n"), *[F.round(k, 4).alias(k) for k in QS])


SQL_QUANTILES = """WITH r AS (
  SELECT l_returnflag, l_linestatus, l_extendedprice AS x, row_number() OVER (PARTITION BY l_returnflag, l_linestatus ORDER BY l_extendedprice) - 1 AS k,
    count(*) OVER (PARTITION BY l_returnflag, l_linestatus) AS n FROM lineitem)
SELECT l_returnflag, l_linestatus, max(n) AS n, round(max(CASE WHEN k = CAST(floor(0.01 * (n - 1) + 0.5) AS BIGINT) THEN x END), 4) AS p01,
  round(max(CASE WHEN k = CAST(floor(0.25 * n) AS BIGINT) THEN x END), 4) AS q1, round(median(x), 4) AS median,
  round(max(CASE WHEN k = CAST(floor(0.99 * (n - 1) + 0.5) AS BIGINT) THEN x END), 4) AS p99
FROM r GROUP BY l_returnflag, l_linestatus"""


# ------------------------------------------------------ profile kept per file (J15) ---
PROFILE_COLUMNS = ("l_quantity", "l_extendedprice", "l_discount", "l_returnflag", "l_shipdate")


def q_profile_by_file(spark, sf):
    """The table lies in files by return flag; one flag's files are dropped, another's lose their small quantities.
    The second profile reads the rewritten files only and merges them with what is kept of the others."""
    base, store = scratch_path(spark, "lineitem"), ProfileStore(spark, scratch_path(spark, "profile"))
    li = table(spark, sf, "lineitem").select(*PROFILE_COLUMNS)
    flags = ("A", "N", "R")
    for f in flags:
        li.where(F.col("l_returnflag") == f).write.parquet(f"{base}/{f}")
    store.update(files_under(spark, base))
    li.where((F.col("l_returnflag") == "N") & (F.col("l_quantity") >= 10)).write.mode("overwrite").parquet(f"{base}/N")
    files = files_under(spark, f"{base}/N") + files_under(spark, f"{base}/R")  # the files of A are dropped
    return store.profile(files).select("column", "rows", "nulls", "missing", "empty", "valid", F.round("mean", 4).alias("mean"),
                                       F.round("std", 4).alias("std"), "min", "max", F.round("sum", 2).alias("sum"), F.round("skew", 6).alias("skew"))


def _profile_sql(c: str) -> str:
    number = c in ("l_quantity", "l_extendedprice", "l_discount")
    x = f"CAST({c} AS DOUBLE)"
    stats = {"mean": f"round(avg({x}), 4)", "std": f"round(stddev_samp({x}), 4)", "min": f"min({x})", "max": f"max({x})", "sum": f"round(sum({x}), 2)",
             "skew": "round(avg(power(x - m, 3)) / power(avg(power(x - m, 2)), 1.5), 6)"}
    sel = ", ".join(f"{(v.replace(x, 'x') if number else 'CAST(NULL AS DOUBLE)')} AS {k}" for k, v in stats.items())
    return (f"SELECT {S.lit(c)} AS \"column\", count(*) AS rows, count(*) - count(x) AS nulls, count(*) - count(x) AS missing, CAST(0 AS BIGINT) AS empty, "
            f"count(x) AS valid, {sel} FROM (SELECT x, {'avg(x) OVER ()' if number else 'NULL'} AS m FROM (SELECT {x if number else c} AS x FROM lineitem "
            "WHERE l_returnflag = 'R' OR l_returnflag = 'N' AND l_quantity >= 10))")


SQL_PROFILE = "\nUNION ALL\n".join(_profile_sql(c) for c in PROFILE_COLUMNS)


# ------------------------------------------------------------------ sample (G5) ---
def q_hash_sample(spark, sf):
    """Whole rows, each drawn by the md5 of its key."""
    return hash_sample(table(spark, sf, "orders"), 300, 7, key=["o_orderkey"]).select("o_orderkey", "o_custkey", "o_totalprice")


SQL_SAMPLE = """SELECT o_orderkey, o_custkey, o_totalprice FROM orders
ORDER BY md5(concat_ws('|', '7', CAST(o_orderkey AS VARCHAR))) LIMIT 300"""

# -------------------------------------------------------------- deep page (G2) ---
def q_deep_page(spark, sf):
    """Page 41 of a sorted table, from the ranges that hold it."""
    pages = SortedPages(table(spark, sf, "lineitem"), "l_extendedprice", True, ["l_orderkey", "l_linenumber"], rows_per_range=1500)
    return pages.page(41, 100).select("l_orderkey", "l_linenumber", "l_extendedprice", "l_shipdate")


SQL_DEEP_PAGE = """SELECT l_orderkey, l_linenumber, l_extendedprice, l_shipdate FROM lineitem
ORDER BY l_extendedprice DESC NULLS FIRST, l_orderkey, l_linenumber LIMIT 100 OFFSET 4000"""


# ------------------------------------------------------------ kept version (J8) ---
def q_recipe_version_kept(spark, sf):
    """The version after two steps, read from what the whole recipe has kept."""
    store, source = VersionStore(spark, scratch_path(spark, "versions")), dirty_orders(spark, sf)
    store.version(RECIPE, source)
    return shape(store.version(RECIPE, source, 2))


# ------------------------------------------------------- dashboard's data (J9, J10) ---
ORDERS_CLASSES = {"o_totalprice": "Numeric", "o_custkey": "Numeric", "o_orderstatus": "Categorical_LowCard",
                  "o_orderpriority": "Categorical_LowCard", "o_orderdate": "Date"}
FILTERS = {"o_orderstatus": ["F", "O"], "o_orderpriority": ["1-URGENT", "2-HIGH", "5-LOW"]}


def _chart_rows(charts):
    """(chart, k, k2, v): every chart's data but the sampled one's, in one long table."""
    out = None
    for i, (kind, _, data) in enumerate(charts):
        if kind == "scatter":
            continue
        c = data.columns
        k2 = F.lit(None).cast("string")
        if kind == "heatmap":
            k2, v = F.col(c[1]).cast("string"), F.col(c[2])
        elif kind == "histogram":
            v = F.col("n")
        elif kind == "box":
            v = F.col("median")
        else:
            v = F.col(c[1])
        key = F.date_format(c[0], "yyyy-MM-dd") if kind == "line" else F.col(c[0]).cast("string")
        part = data.select(F.lit(f"{i} {kind}").alias("chart"), key.alias("k"), k2.alias("k2"), F.round(v.cast("double"), 2).alias("v"))
        out = part if out is None else out.unionByName(part)
    return out


def q_dashboard_charts(spark, sf):
    """The data of each chart; counts and totals from one grouping-sets aggregate."""
    df = table(spark, sf, "orders")
    return _chart_rows(dashboard_charts(df, ORDERS_CLASSES, cube_of(df, ORDERS_CLASSES)))


def q_filtered_charts(spark, sf):
    """The same under filters on two categories, which the cube answers itself."""
    df = table(spark, sf, "orders")
    return _chart_rows(filtered_dashboard(df, FILTERS, ORDERS_CLASSES, cube=cube_of(df, ORDERS_CLASSES))["charts"])


def q_filtered_cube_kpis(spark, sf):
    """KPIs under filters, from the cube alone."""
    df = table(spark, sf, "orders")
    return kpis(df, ORDERS_CLASSES, totals=cube_of(df, ORDERS_CLASSES).totals(FILTERS))


def _charts_sql(where: str) -> str:
    return f"""WITH f AS (SELECT * FROM orders {where}), b AS (SELECT min(o_totalprice) AS mn, max(o_totalprice) AS mx FROM f),
  dates AS (SELECT o_orderdate, sum(o_totalprice) AS s FROM f GROUP BY 1 ORDER BY 1 DESC LIMIT 50),
  bins AS (SELECT CASE WHEN mx = mn THEN 1 ELSE least(15, greatest(1, CAST(floor((o_totalprice - mn) / ((mx - mn) / 15)) AS INTEGER) + 1)) END AS bin, count(*) AS n
    FROM f, b GROUP BY 1),
  r AS (SELECT o_orderstatus, o_totalprice, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice) - 1 AS i, count(*) OVER (PARTITION BY o_orderstatus) AS n FROM f)
SELECT '0 donut' AS chart, o_orderstatus AS k, CAST(NULL AS VARCHAR) AS k2, CAST(count(*) AS DOUBLE) AS v FROM f GROUP BY 2
UNION ALL SELECT '1 donut', o_orderpriority, NULL, count(*) FROM f GROUP BY 2
UNION ALL SELECT '2 horizontal_bar', o_orderstatus, NULL, round(sum(o_totalprice), 2) FROM f GROUP BY 2
UNION ALL SELECT '3 line', strftime(o_orderdate, '%Y-%m-%d'), NULL, round(s, 2) FROM dates
UNION ALL SELECT '5 histogram', CAST(u.bin AS VARCHAR), NULL, coalesce(n, 0) FROM (SELECT unnest(range(1, 16)) AS bin) u LEFT JOIN bins USING (bin)
UNION ALL SELECT '6 box', o_orderstatus, NULL, round(max(CASE WHEN i = CAST(floor(0.5 * n) AS BIGINT) THEN o_totalprice END), 2) FROM r GROUP BY 2
UNION ALL SELECT '7 heatmap', o_orderstatus, o_orderpriority, round(sum(o_totalprice), 2) FROM f GROUP BY 2, 3"""


SQL_FILTERS = "WHERE o_orderstatus IN ('F', 'O') AND o_orderpriority IN ('1-URGENT', '2-HIGH', '5-LOW')"
SQL_CUBE_KPIS = f"""WITH f AS (SELECT * FROM orders {SQL_FILTERS})
SELECT 'Total Records' AS title, CAST(count(*) AS DOUBLE) AS value, 'count' AS type, CAST(NULL AS VARCHAR) AS "column", 'number' AS format FROM f
UNION ALL SELECT 'Sum o_totalprice', round(sum(o_totalprice), 2), 'sum', 'o_totalprice', 'currency' FROM f
UNION ALL SELECT 'Average o_custkey', round(avg(o_custkey), 2), 'average', 'o_custkey', 'number' FROM f"""


# --------------------------------------------------- search by an index (B11, B12) ---
def _indexed_documents(spark, sf):
    """``documents`` in files of a language each, several where it is large, and their index."""
    docs, base = table(spark, sf, "documents"), scratch_path(spark, "documents")
    docs.hint("rebalance", "lang").write.option("maxRecordsPerFile", 2_000_000).parquet(base)
    index = SearchIndex(spark, scratch_path(spark, "search"))
    index.update(files_under(spark, base))
    return index, base


def q_search_indexed(spark, sf):
    """A literal, in those files alone that can hold it."""
    index, base = _indexed_documents(spark, sf)
    return index.search(base, "All Rights Reserved").select("doc_id", "lang", "source")


def q_search_pattern(spark, sf):
    """A pattern, in those files alone that can hold its fixed parts."""
    index, base = _indexed_documents(spark, sf)
    return index.search(base, r"rights? reserved[.,;]?", regex=True, columns=["text"]).select("doc_id", "lang", "source")


# ---------------------------------------------- correlations of a wide table (E24) ---
WIDE_COLUMNS = 40


def _wide_cell(k: int) -> str:
    x = f"(l_orderkey * {k + 3} + l_partkey * {k * k + 1} + l_linenumber * {7 + k % 3}) % {90 + k * 4}"
    return f"CASE WHEN {k} % 5 = 0 AND l_linenumber = {k % 7 + 1} THEN NULL ELSE CAST({x} AS DOUBLE) + {k % 4} * l_quantity END"


def q_corr_wide(spark, sf):
    """The correlation matrix of forty columns, some with nulls, from one row of co-moments a pair."""
    cols = [f"w{k}" for k in range(WIDE_COLUMNS)]
    return corr_matrix(table(spark, sf, "lineitem").selectExpr(*[f"{_wide_cell(k)} AS w{k}" for k in range(WIDE_COLUMNS)]), cols, 2)


SQL_CORR_WIDE = f"""WITH w AS (SELECT {", ".join(f"{_wide_cell(k)} AS w{k}" for k in range(WIDE_COLUMNS))} FROM lineitem),
  m AS (SELECT {", ".join(f"coalesce(round(corr(w{a}, w{b}), 2), 0) + 0.0 AS r{a}_{b}" for a in range(WIDE_COLUMNS) for b in range(a, WIDE_COLUMNS))} FROM w)
SELECT x, y, r FROM (SELECT unnest([{", ".join(f"{{'x': 'w{a}', 'y': 'w{b}', 'r': r{min(a, b)}_{max(a, b)}}}" for a in range(WIDE_COLUMNS) for b in range(WIDE_COLUMNS))}], recursive := true) FROM m)"""


QUERIES = {
    "search_indexed": (q_search_indexed, "SELECT doc_id, lang, source FROM documents WHERE contains(lower(coalesce(text, '')), 'all rights reserved') "
                                         "OR contains(lower(coalesce(lang, '')), 'all rights reserved') OR contains(lower(coalesce(source, '')), 'all rights reserved')"),
    "search_pattern": (q_search_pattern, "SELECT doc_id, lang, source FROM documents WHERE regexp_matches(lower(text), 'rights? reserved[.,;]?')"),
    "corr_wide": (q_corr_wide, SQL_CORR_WIDE),
    "deep_page": (q_deep_page, SQL_DEEP_PAGE),
    "recipe_version_kept": (q_recipe_version_kept, DASHBOARD_QUERIES["recipe_version"][1]),
    "dashboard_charts": (q_dashboard_charts, _charts_sql("")),
    "filtered_charts": (q_filtered_charts, _charts_sql(SQL_FILTERS)),
    "filtered_cube_kpis": (q_filtered_cube_kpis, SQL_CUBE_KPIS),
    "column_modes": (q_column_modes, SQL_MODES),
    "quantiles_by_group": (q_quantiles_by_group, SQL_QUANTILES),
    "profile_by_file": (q_profile_by_file, SQL_PROFILE),
    "hash_sample": (q_hash_sample, SQL_SAMPLE),
}
