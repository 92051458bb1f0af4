"""Registered queries, phase 6: chart aggregates over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import charts as C
from ..operators.table import apply_filters
from . import sqlgen as S
from .views import DIRTY_ORDERS_SQL, table


def _date_txt(c):
    return F.date_format(F.col(c), "yyyy-MM-dd").alias(c)


def q_value_counts(spark, sf):
    return C.value_counts(table(spark, sf, "events"), "event_type", 10)


SQL_VALUE_COUNTS = ("SELECT event_type, count(*) AS count FROM events GROUP BY event_type "
                    "ORDER BY count DESC, event_type ASC NULLS LAST LIMIT 10")


def q_sum_by_cat_topk(spark, sf):
    g = C.sum_by(table(spark, sf, "lineitem"), "l_suppkey", "l_extendedprice", 15)
    return g.select("l_suppkey", F.round("l_extendedprice", 2).alias("l_extendedprice"))


SQL_SUM_BY_CAT = ("SELECT l_suppkey, round(l_extendedprice, 2) AS l_extendedprice FROM ("
                  "SELECT l_suppkey, coalesce(sum(l_extendedprice), 0) AS l_extendedprice FROM lineitem "
                  "GROUP BY l_suppkey ORDER BY l_extendedprice DESC, l_suppkey ASC NULLS LAST LIMIT 15)")


def q_sum_by_treemap(spark, sf):
    g = C.sum_by(table(spark, sf, "part"), "p_brand", "p_retailprice", 50)
    return g.select("p_brand", F.round("p_retailprice", 2).alias("p_retailprice"))


SQL_TREEMAP = ("SELECT p_brand, round(p_retailprice, 2) AS p_retailprice FROM ("
               "SELECT p_brand, coalesce(sum(p_retailprice), 0) AS p_retailprice FROM part "
               "GROUP BY p_brand ORDER BY p_retailprice DESC, p_brand ASC NULLS LAST LIMIT 50)")


def q_sum_by_date_last50(spark, sf):
    g = C.sum_by_date(table(spark, sf, "orders"), "o_orderdate", "o_totalprice", 50)
    return g.select(_date_txt("o_orderdate"), F.round("o_totalprice", 2).alias("o_totalprice"))


SQL_SUM_BY_DATE = ("SELECT strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate, round(s, 2) AS o_totalprice FROM ("
                   "SELECT o_orderdate, sum(o_totalprice) AS s FROM orders WHERE o_orderdate IS NOT NULL "
                   "GROUP BY o_orderdate ORDER BY o_orderdate DESC LIMIT 50)")


def q_two_key_sum(spark, sf):
    g = C.sum_matrix(table(spark, sf, "lineitem"), "l_returnflag", "l_linestatus", "l_quantity")
    return g.select("l_returnflag", "l_linestatus", F.round("l_quantity", 2).alias("l_quantity"))


SQL_TWO_KEY = ("SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS l_quantity FROM lineitem "
               "GROUP BY l_returnflag, l_linestatus")


def q_pivot_sum(spark, sf):
    g = C.sum_matrix(table(spark, sf, "lineitem"), "l_returnflag", "l_linestatus", "l_quantity", pivot=True)
    return g.select("l_returnflag", *[F.round(F.col(c), 2).alias(c) for c in g.columns if c != "l_returnflag"])


SQL_PIVOT = ("SELECT l_returnflag, round(coalesce(sum(l_quantity) FILTER (WHERE l_linestatus = 'F'), 0), 2) AS \"F\", "
             "round(coalesce(sum(l_quantity) FILTER (WHERE l_linestatus = 'O'), 0), 2) AS \"O\" "
             "FROM lineitem GROUP BY l_returnflag")


def q_crosstab(spark, sf):
    return C.crosstab(table(spark, sf, "lineitem"), "l_returnflag", "l_linestatus", 15)


SQL_CROSSTAB = """WITH d AS (SELECT l_returnflag, l_linestatus FROM lineitem
                 WHERE l_returnflag IS NOT NULL AND l_linestatus IS NOT NULL),
xs AS (SELECT DISTINCT l_returnflag FROM d ORDER BY l_returnflag LIMIT 15),
ys AS (SELECT DISTINCT l_linestatus FROM d)
SELECT xs.l_returnflag, ys.l_linestatus,
  (SELECT count(*) FROM d WHERE d.l_returnflag = xs.l_returnflag AND d.l_linestatus = ys.l_linestatus) AS n
FROM xs, ys"""


def q_mean_by_cat(spark, sf):
    g = C.mean_by(table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice", 20)
    return g.select("l_quantity", F.round("l_extendedprice", 4).alias("l_extendedprice"),
                    F.round("cv", 4).alias("cv"))


SQL_MEAN_BY = """WITH g AS (SELECT l_quantity, avg(l_extendedprice) AS m FROM lineitem WHERE l_quantity IS NOT NULL
                 GROUP BY l_quantity HAVING avg(l_extendedprice) IS NOT NULL ORDER BY m DESC, l_quantity LIMIT 20),
c AS (SELECT stddev_samp(m) / avg(m) AS cv FROM g)
SELECT l_quantity, round(m, 4) AS l_extendedprice, round(cv, 4) AS cv FROM g, c WHERE abs(coalesce(cv, 0)) > 0.05"""


def q_mean_by_nation(spark, sf):
    g = C.mean_by(table(spark, sf, "supplier"), "s_nationkey", "s_acctbal", 20)
    return g.select("s_nationkey", F.round("s_acctbal", 5).alias("s_acctbal"), F.round("cv", 4).alias("cv"))


SQL_MEAN_BY_NATION = """WITH g AS (SELECT s_nationkey, avg(s_acctbal) AS m FROM supplier WHERE s_nationkey IS NOT NULL
                 GROUP BY s_nationkey HAVING avg(s_acctbal) IS NOT NULL ORDER BY m DESC, s_nationkey LIMIT 20),
c AS (SELECT stddev_samp(m) / avg(m) AS cv FROM g)
SELECT s_nationkey, round(m, 5) AS s_acctbal, round(cv, 4) AS cv FROM g, c WHERE abs(coalesce(cv, 0)) > 0.05"""


def q_monthly_mean(spark, sf):
    m = C.monthly_mean(table(spark, sf, "orders"), "o_orderdate", "o_totalprice")
    return m.select(F.date_format("month", "yyyy-MM-dd").alias("month"), F.round("o_totalprice", 5).alias("o_totalprice"))


SQL_MONTHLY = """WITH b AS (SELECT date_trunc('month', min(o_orderdate)) AS a, date_trunc('month', max(o_orderdate)) AS z FROM orders),
sp AS (SELECT last_day(CAST(m AS DATE)) AS month FROM b, generate_series(b.a, b.z, INTERVAL 1 MONTH) t(m)),
g AS (SELECT last_day(CAST(o_orderdate AS DATE)) AS month, avg(o_totalprice) AS v FROM orders
      WHERE o_orderdate IS NOT NULL GROUP BY 1)
SELECT strftime(sp.month, '%Y-%m-%d') AS month, round(g.v, 5) AS o_totalprice FROM sp LEFT JOIN g USING (month)"""


def q_trend_summary(spark, sf):
    m = C.monthly_mean(table(spark, sf, "orders"), "o_orderdate", "o_totalprice")
    t = C.trend_summary(m, "o_totalprice")
    return t.select("months", F.round("first", 5).alias("first"), F.round("last", 5).alias("last"),
                    F.round("pct_change", 4).alias("pct_change"),
                    F.date_format("peak_month", "yyyy-MM-dd").alias("peak_month"), F.round("cv", 4).alias("cv"), "keep")


SQL_TREND = """WITH b AS (SELECT date_trunc('month', min(o_orderdate)) AS a, date_trunc('month', max(o_orderdate)) AS z FROM orders),
sp AS (SELECT last_day(CAST(m AS DATE)) AS month FROM b, generate_series(b.a, b.z, INTERVAL 1 MONTH) t(m)),
g AS (SELECT last_day(CAST(o_orderdate AS DATE)) AS month, avg(o_totalprice) AS v FROM orders GROUP BY 1),
m AS (SELECT sp.month, g.v FROM sp LEFT JOIN g USING (month)),
s AS (SELECT count(*) AS months, arg_min(v, month) AS first, arg_max(v, month) AS last,
        (SELECT month FROM m WHERE v IS NOT NULL ORDER BY v DESC, month LIMIT 1) AS peak_month,
        stddev_samp(v) AS sd, avg(v) AS mu FROM m),
t AS (SELECT months, first, last,
        CASE WHEN first IS NOT NULL AND first <> 0 THEN (last - first) / first * 100 ELSE 0 END AS pct_change,
        peak_month, CASE WHEN mu <> 0 THEN abs(sd / mu) ELSE 0 END AS cv FROM s)
SELECT months, round(first, 5) AS first, round(last, 5) AS last, round(pct_change, 4) AS pct_change,
  strftime(peak_month, '%Y-%m-%d') AS peak_month, round(cv, 4) AS cv,
  months >= 2 AND NOT (coalesce(cv, 0) < 0.05 AND abs(pct_change) < 5) AS keep FROM t"""

CORR_COLS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


def q_corr_matrix(spark, sf):
    return C.corr_matrix(table(spark, sf, "lineitem"), CORR_COLS, 2)


def _corr_sql():
    parts = []
    for a in CORR_COLS:
        for b in CORR_COLS:
            parts.append(f"SELECT {S.lit(a)} AS x, {S.lit(b)} AS y, coalesce(round(corr({a}, {b}), 2), 0) + 0.0 AS r "
                         f"FROM lineitem")
    return "\nUNION ALL\n".join(parts)


def _hist(spark, sf, tbl, col, bins, closed):
    h = C.histogram(table(spark, sf, tbl), col, bins, closed)
    return h.select("bin", F.round("lo", 4).alias("lo"), F.round("hi", 4).alias("hi"), "n")


def hist_sql(tbl, col, bins, closed):
    x = f"CAST({col} AS DOUBLE)"
    if closed == "right":
        b = (f"CASE WHEN w = 0 THEN {bins // 2} ELSE greatest(1, least({bins}, CAST(ceil((x - mn) / w) AS BIGINT))) END")
        lo = f"CASE WHEN bin = 1 THEN mn - (mx - mn) * 0.001 ELSE mn + (bin - 1) * w END"
    else:
        b = (f"CASE WHEN w = 0 THEN 1 ELSE least({bins}, greatest(1, CAST(floor((x - mn) / w) AS BIGINT) + 1)) END")
        lo = "mn + (bin - 1) * w"
    return f"""WITH d AS (SELECT {x} AS x FROM {tbl} WHERE {col} IS NOT NULL AND NOT isnan({x})),
mm AS (SELECT min(x) AS mn, max(x) AS mx, (max(x) - min(x)) / {float(bins)} AS w FROM d),
c AS (SELECT {b} AS bin, count(*) AS n FROM d, mm GROUP BY 1),
sp AS (SELECT CAST(i AS INTEGER) AS bin, mn, mx, w FROM mm, range(1, {bins + 1}) t(i))
SELECT sp.bin, round({lo}, 4) AS lo, round(CASE WHEN sp.bin = {bins} THEN mx ELSE mn + sp.bin * w END, 4) AS hi,
  CAST(coalesce(c.n, 0) AS BIGINT) AS n
FROM sp LEFT JOIN c USING (bin) WHERE mn IS NOT NULL"""


def q_box_by_cat(spark, sf):
    b = C.box_summary(table(spark, sf, "orders"), "o_orderpriority", "o_totalprice", 15)
    return b


SQL_BOX = f"""WITH d AS (SELECT o_orderpriority, CAST(o_totalprice AS DOUBLE) AS v FROM orders
                WHERE o_orderpriority IS NOT NULL AND o_totalprice IS NOT NULL),
cats AS (SELECT DISTINCT o_orderpriority FROM d ORDER BY o_orderpriority LIMIT 15)
SELECT o_orderpriority, min(v) AS min, {S.floor_n('v', 0.25)} AS q1, {S.floor_n('v', 0.5)} AS median,
  {S.floor_n('v', 0.75)} AS q3, max(v) AS max, count(v) AS n
FROM d WHERE o_orderpriority IN (SELECT o_orderpriority FROM cats) GROUP BY o_orderpriority"""

FILTERS = {"o_orderstatus": ["F", "O"], "o_totalprice": {"min": 1000.0, "max": 300000.0}}


def q_filtered_sum(spark, sf):
    f = apply_filters(table(spark, sf, "orders"), FILTERS)
    g = C.sum_by(f, "o_orderpriority", "o_totalprice", 15)
    return g.select("o_orderpriority", F.round("o_totalprice", 2).alias("o_totalprice"))


SQL_FILTERED = ("SELECT o_orderpriority, round(s, 2) AS o_totalprice FROM (SELECT o_orderpriority, "
                "coalesce(sum(o_totalprice), 0) AS s FROM orders WHERE o_orderstatus IN ('F', 'O') "
                "AND o_totalprice >= 1000.0 AND o_totalprice <= 300000.0 GROUP BY o_orderpriority "
                "ORDER BY s DESC, o_orderpriority LIMIT 15)")


def q_upper_anomalies(spark, sf):
    return C.upper_anomalies(table(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice", "l_tax"])


SQL_ANOMALIES = "\nUNION ALL\n".join(
    f"SELECT {S.lit(c)} AS \"column\", count_if({c} > (SELECT avg({c}) + 3 * stddev_samp({c}) FROM lineitem)) AS anomalies "
    f"FROM lineitem HAVING count({c}) > 10 AND stddev_samp({c}) > 0" for c in ("l_quantity", "l_extendedprice", "l_tax"))


def q_scatter_sample(spark, sf):
    return C.scatter_sample(table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice", 500, key=["l_orderkey", "l_linenumber"])


SQL_SCATTER = """SELECT l_quantity, l_extendedprice FROM lineitem WHERE l_quantity IS NOT NULL AND l_extendedprice IS NOT NULL
ORDER BY md5(concat_ws('|', '42', CAST(l_orderkey AS VARCHAR), CAST(l_linenumber AS VARCHAR))), l_quantity, l_extendedprice LIMIT 500"""


def q_strongest_pair(spark, sf):
    """The strongest pair of a correlation matrix."""
    li = table(spark, sf, "lineitem")
    return C.strongest_pair(C.corr_matrix(li, ["l_quantity", "l_extendedprice", "l_discount", "l_tax"], 2), 0.0)


SQL_STRONGEST = "SELECT x, y, r FROM (" + "\nUNION ALL\n".join(
    f"SELECT {S.lit(a)} AS x, {S.lit(b)} AS y, round(corr({a}, {b}), 2) AS r FROM lineitem"
    for a, b in (("l_extendedprice", "l_quantity"), ("l_discount", "l_quantity"), ("l_discount", "l_extendedprice"), ("l_quantity", "l_tax"),
                 ("l_extendedprice", "l_tax"), ("l_discount", "l_tax"))) + ") WHERE abs(r) > 0 ORDER BY abs(r) DESC, x, y LIMIT 1"


def q_peak_bin(spark, sf):
    """The fullest of 20 bins."""
    p = C.peak_bin(C.histogram(table(spark, sf, "orders"), "o_totalprice", 20, "right"))
    return p.select("bin", "n", F.round("share_pct", 6).alias("share_pct"))


SQL_PEAK = ("WITH h AS (" + hist_sql("orders", "o_totalprice", 20, "right") +
            ") SELECT bin, n, round(n / (SELECT sum(n) FROM h) * 100, 6) AS share_pct FROM h ORDER BY n DESC, bin LIMIT 1")


QUERIES = {
    "value_counts": (q_value_counts, SQL_VALUE_COUNTS),
    "sum_by_cat_topk": (q_sum_by_cat_topk, SQL_SUM_BY_CAT),
    "sum_by_treemap": (q_sum_by_treemap, SQL_TREEMAP),
    "sum_by_date_last50": (q_sum_by_date_last50, SQL_SUM_BY_DATE),
    "two_key_sum": (q_two_key_sum, SQL_TWO_KEY),
    "pivot_sum": (q_pivot_sum, SQL_PIVOT),
    "crosstab": (q_crosstab, SQL_CROSSTAB),
    "mean_by_cat": (q_mean_by_cat, SQL_MEAN_BY),
    "mean_by_nation": (q_mean_by_nation, SQL_MEAN_BY_NATION),
    "monthly_mean": (q_monthly_mean, SQL_MONTHLY),
    "trend_summary": (q_trend_summary, SQL_TREND),
    "corr_matrix": (q_corr_matrix, _corr_sql()),
    "hist20": (lambda s, f: _hist(s, f, "orders", "o_totalprice", 20, "right"),
               hist_sql("orders", "o_totalprice", 20, "right")),
    "hist10": (lambda s, f: _hist(s, f, "lineitem", "l_extendedprice", 10, "left"),
               hist_sql("lineitem", "l_extendedprice", 10, "left")),
    "hist15": (lambda s, f: _hist(s, f, "customer", "c_acctbal", 15, "left"),
               hist_sql("customer", "c_acctbal", 15, "left")),
    "box_by_cat": (q_box_by_cat, SQL_BOX),
    "filtered_sum": (q_filtered_sum, SQL_FILTERED),
    "upper_anomalies": (q_upper_anomalies, SQL_ANOMALIES),
    "scatter_sample": (q_scatter_sample, SQL_SCATTER),
    "strongest_pair": (q_strongest_pair, SQL_STRONGEST),
    "peak_bin": (q_peak_bin, SQL_PEAK),
}


def q_value_counts_labelled(spark, sf):
    """Category distribution with null labelled 'Unknown' (dirty priority)."""
    from ..operators.analysis import Analysis
    from .views import dirty_orders
    a = Analysis(dirty_orders(spark, sf))
    return C.value_counts(a.typed, "priority", 10, null_label="Unknown")


SQL_VC_LABELLED = ("WITH dirty_orders AS (" + DIRTY_ORDERS_SQL +
                   ")\nSELECT coalesce(priority, 'Unknown') AS priority, count FROM (SELECT priority, count(*) AS count "
                   "FROM dirty_orders GROUP BY priority ORDER BY count DESC, priority ASC NULLS LAST LIMIT 10)")

QUERIES["value_counts_labelled"] = (q_value_counts_labelled, SQL_VC_LABELLED)
