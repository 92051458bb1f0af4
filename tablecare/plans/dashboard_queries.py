"""Registered queries, phase 7: dashboards, recommender, recipe, re-profile."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import charts as C
from ..operators.analysis import Analysis
from ..operators.dashboard import auto_kpis, auto_slicers, classes_of, insights, kpis, slicers
from ..operators.duplicates import duplicate_totals, extra_duplicates
from ..operators.profile import reprofile
from ..operators.table import apply_filters
from . import sqlgen as S
from .clean_queries import TYPED, emp, miss, shape
from .planner import plan_charts, plan_table
from .quality import column_table
from .quality_queries import DIRTY_KINDS, DIRTY_PROMOTED, dirty_norm_sql
from .recipe import Recipe, Step
from .recommend import recommend_methods
from .report_queries import dirty_columns_sql
from .views import DIRTY_KEYS, DIRTY_ORDER, dirty_cte, dirty_orders, table


def q_kpis_sales(spark, sf):
    o = table(spark, sf, "orders")
    return kpis(o, classes_of(o), "Sales")


SQL_KPIS_SALES = """SELECT 'Total Sales' AS title, CAST(count(*) AS DOUBLE) AS value, 'count' AS type,
  CAST(NULL AS VARCHAR) AS "column", 'number' AS format FROM orders
UNION ALL SELECT 'Average o_orderkey', round(avg(o_orderkey), 2), 'average', 'o_orderkey', 'number' FROM orders
UNION ALL SELECT 'Average o_custkey', round(avg(o_custkey), 2), 'average', 'o_custkey', 'number' FROM orders
UNION ALL SELECT 'Sum o_totalprice', round(sum(o_totalprice), 2), 'sum', 'o_totalprice', 'currency' FROM orders"""

KPI_FILTERS = {"o_orderpriority": ["1-URGENT", "2-HIGH"], "o_totalprice": {"min": 50000.0}}


def q_filtered_kpis(spark, sf):
    o = table(spark, sf, "orders")
    return kpis(apply_filters(o, KPI_FILTERS), classes_of(o), "Sales")


SQL_FILTERED_KPIS = SQL_KPIS_SALES.replace(
    "FROM orders", "FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_totalprice >= 50000.0")


def q_auto_kpis(spark, sf):
    return auto_kpis(table(spark, sf, "orders"))


def _kmb(x):
    return (f"CASE WHEN {x} > 1e9 THEN printf('%.1fB', {x} / 1e9) WHEN {x} > 1e6 THEN printf('%.1fM', {x} / 1e6) "
            f"WHEN {x} > 1e3 THEN printf('%.1fK', {x} / 1e3) ELSE CAST(round({x}, 2) AS VARCHAR) END")


SQL_AUTO_KPIS = f"""SELECT 'Total Rows' AS title, format('{{:,}}', count(*)) AS value, '' AS prefix FROM orders
UNION ALL SELECT 'Total Columns', '6', ''
UNION ALL SELECT 'Total o_totalprice', {_kmb('sum(o_totalprice)')}, '$' FROM orders
UNION ALL SELECT 'Avg o_totalprice', {_kmb('avg(o_totalprice)')}, '$' FROM orders
UNION ALL SELECT 'Unique o_orderprioritys', CAST(count(DISTINCT o_orderpriority) AS VARCHAR), '' FROM orders"""


def q_slicer_options(spark, sf):
    o = table(spark, sf, "orders")
    s = slicers(o, classes_of(o))
    return s.select("column", "type", F.concat_ws("|", "options").alias("options"), "min", "max")


SQL_SLICERS = """SELECT 'o_orderstatus' AS "column", 'categorical' AS type,
  (SELECT string_agg(v, '|' ORDER BY v) FROM (SELECT DISTINCT o_orderstatus AS v FROM orders WHERE o_orderstatus IS NOT NULL)) AS options,
  CAST(NULL AS DOUBLE) AS min, CAST(NULL AS DOUBLE) AS max
UNION ALL SELECT 'o_orderpriority', 'categorical',
  (SELECT string_agg(v, '|' ORDER BY v) FROM (SELECT DISTINCT o_orderpriority AS v FROM orders WHERE o_orderpriority IS NOT NULL)),
  NULL, NULL
UNION ALL SELECT 'o_orderdate', 'date_range', '', NULL, NULL
UNION ALL SELECT 'o_orderkey', 'range', '', min(o_orderkey), max(o_orderkey) FROM orders
UNION ALL SELECT 'o_custkey', 'range', '', min(o_custkey), max(o_custkey) FROM orders"""


def q_insights(spark, sf):
    o = table(spark, sf, "orders")
    bar = C.sum_by(o, "o_orderstatus", "o_totalprice", 15)
    i = insights(o, classes_of(o), bar)
    return i.select("kind", "column", F.round("value", 2).alias("value"))


SQL_INSIGHTS = """SELECT 'records' AS kind, CAST(NULL AS VARCHAR) AS "column", CAST(count(*) AS DOUBLE) AS value FROM orders
UNION ALL SELECT 'missing', NULL, CAST(count_if(o_orderkey IS NULL) + count_if(o_custkey IS NULL)
  + count_if(o_orderstatus IS NULL) + count_if(o_totalprice IS NULL) + count_if(o_orderdate IS NULL)
  + count_if(o_orderpriority IS NULL) AS DOUBLE) FROM orders
UNION ALL SELECT 'duplicates', NULL, CAST(count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM orders)) AS DOUBLE) FROM orders
UNION ALL SELECT * FROM (SELECT 'top_item', 'o_orderstatus', round(sum(o_totalprice), 2) FROM orders
  GROUP BY o_orderstatus ORDER BY sum(o_totalprice) DESC, o_orderstatus LIMIT 1)
UNION ALL SELECT * FROM (SELECT 'anomalies', c, CAST(n AS DOUBLE) FROM (
  SELECT 'o_orderkey' AS c, count_if(o_orderkey > (SELECT avg(o_orderkey) + 3 * stddev_samp(o_orderkey) FROM orders)) AS n FROM orders
  UNION ALL SELECT 'o_custkey', count_if(o_custkey > (SELECT avg(o_custkey) + 3 * stddev_samp(o_custkey) FROM orders)) FROM orders
  UNION ALL SELECT 'o_totalprice', count_if(o_totalprice > (SELECT avg(o_totalprice) + 3 * stddev_samp(o_totalprice) FROM orders)) FROM orders)
  WHERE n > 0)
UNION ALL SELECT * FROM (SELECT 'correlation', 'o_orderkey,o_custkey', round(corr(o_orderkey, o_custkey), 2) FROM orders
  HAVING abs(round(corr(o_orderkey, o_custkey), 2)) > 0.7)"""


def q_recommend_methods(spark, sf):
    return recommend_methods(column_table(Analysis(dirty_orders(spark, sf))))


SQL_RECOMMEND_METHODS = dirty_columns_sql() + """,
act AS (SELECT * FROM cols WHERE active),
r AS (
  SELECT "column", 'Missing Values' AS issue, CASE WHEN missing * 100.0 / rows > 50 THEN 'Drop Column'
    WHEN class = 'Numeric' AND outliers > 0 THEN 'Fill with Median' WHEN class = 'Numeric' THEN 'Fill with Mean'
    WHEN class = 'Date' THEN 'Fill using Previous Value' ELSE 'Fill with Mode' END AS method FROM act WHERE missing > 0
  UNION ALL SELECT "column", 'Empty Cells', CASE WHEN class = 'Numeric' THEN 'Replace with Mean'
    WHEN class = 'Categorical' THEN 'Replace with Mode' WHEN class = 'Date' THEN 'Replace with Previous Value'
    ELSE 'Replace with Custom Value' END FROM act WHERE empty > 0
  UNION ALL SELECT "column", 'Outliers', CASE WHEN outliers * 100.0 / rows < 1 THEN 'Manual Review'
    WHEN regexp_matches(lower("column"), 'price|amount|salary|revenue') THEN 'Keep Outliers'
    ELSE 'Replace using Median' END FROM act WHERE outliers > 0
  UNION ALL SELECT "column", 'Invalid Data Types', 'Convert to Numeric' FROM act WHERE invalid > 0
  UNION ALL SELECT "column", 'Inconsistent Categories', 'Standardize Format' FROM act WHERE inconsistent)
SELECT * FROM r"""

RECIPE = Recipe([Step("Extra Spaces", "Trim Spaces"),
                 Step("Missing Values", "Fill with Median", ("price",)),
                 Step("Duplicate Rows", "Keep First", DIRTY_KEYS)], order_by=list(DIRTY_ORDER))


def q_recipe_replay(spark, sf):
    return shape(RECIPE.apply(dirty_orders(spark, sf)))


def _recipe_sql():
    txt = [c for c, k in DIRTY_KINDS.items() if k == "text" and c not in DIRTY_PROMOTED]
    trimmed = ", ".join(f"{S.strip(S.q(c))} AS {c}" if c in txt else S.q(c) for c in DIRTY_KINDS)
    med = "(SELECT median(price) FROM s1 WHERE NOT isnan(price))"
    keys = ", ".join(S.q(c) for c in DIRTY_KEYS)
    return TYPED + f""", s1 AS (SELECT rid, {trimmed} FROM typed),
s2 AS (SELECT * REPLACE (CASE WHEN price IS NULL OR isnan(price) THEN {med} ELSE price END AS price) FROM s1),
s3 AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY rid) AS rn FROM s2)
SELECT row_key, priority, round(price_text, 4) AS price_text, round(price, 4) AS price, email, status,
  CAST(ordered_at AS VARCHAR) AS ordered_at, copy_no FROM s3 WHERE rn = 1"""


def q_reprofile(spark, sf):
    a = Analysis(dirty_orders(spark, sf))
    old = a.profile_df
    from ..operators.clean import clean
    after = clean(a, "Missing Values", ["price"], "Fill with Median")
    p = reprofile(after, old, ["price"])
    return p.select("column", "missing", "empty", "valid", F.round("mean", 4).alias("mean"))


def _reprofile_sql():
    med = "(SELECT median(price) FROM typed WHERE NOT isnan(price))"
    parts = []
    for c, k in DIRTY_KINDS.items():
        x = S.q(c)
        if c == "price":
            src = f"CASE WHEN price IS NULL OR isnan(price) THEN {med} ELSE price END"
            m, e = f"({src}) IS NULL", "false"
            mean = f"round(avg({src}), 4)"
        else:
            m, e = miss(c), emp(c)
            mean = f"round(avg(CAST({x} AS DOUBLE)), 4)" if (k in ("int", "float") or c in DIRTY_PROMOTED) else "NULL"
        parts.append(f"SELECT {S.lit(c)} AS \"column\", count_if({m}) AS missing, count_if({e}) AS empty, "
                     f"count(*) - count_if({m}) - count_if({e}) AS valid, {mean} AS mean FROM typed")
    return TYPED + "\n" + "\nUNION ALL\n".join(parts)


def q_duplicate_totals(spark, sf):
    a = Analysis(dirty_orders(spark, sf))
    return duplicate_totals(a.typed, keys=list(DIRTY_KEYS))


SQL_DUP_TOTALS = dirty_cte(f"""SELECT CAST(coalesce(sum(n), 0) AS BIGINT) AS duplicate_rows, count(*) AS duplicate_groups FROM (
  SELECT count(*) AS n FROM dirty_orders GROUP BY {', '.join(dirty_norm_sql(c) for c in DIRTY_KEYS)}) WHERE n > 1""")


def q_extra_duplicates(spark, sf):
    return extra_duplicates(dirty_orders(spark, sf).drop("copy_no"))


SQL_EXTRA_DUPS = dirty_cte("""SELECT (SELECT count(*) FROM dirty_orders) - (SELECT count(*) FROM (SELECT DISTINCT
  row_key, priority, price_text, price, email, status, ordered_at FROM dirty_orders)) AS extra_duplicates""")


def q_chart_plan(spark, sf):
    p = plan_charts(table(spark, sf, "orders"))
    return plan_table(p, spark)


QUERIES = {
    "kpis_sales": (q_kpis_sales, SQL_KPIS_SALES),
    "filtered_kpis": (q_filtered_kpis, SQL_FILTERED_KPIS),
    "auto_kpis": (q_auto_kpis, SQL_AUTO_KPIS),
    "slicer_options": (q_slicer_options, SQL_SLICERS),
    "insights": (q_insights, SQL_INSIGHTS),
    "recommend_methods": (q_recommend_methods, SQL_RECOMMEND_METHODS),
    "recipe_replay": (q_recipe_replay, _recipe_sql()),
    "reprofile": (q_reprofile, _reprofile_sql()),
    "duplicate_totals": (q_duplicate_totals, SQL_DUP_TOTALS),
    "extra_duplicates": (q_extra_duplicates, SQL_EXTRA_DUPS),
    "chart_plan": (q_chart_plan, None),
}


def q_recipe_version(spark, sf):
    """The version after the first two recipe steps."""
    return shape(RECIPE.apply(dirty_orders(spark, sf), upto=2))


def _version_sql():
    full = _recipe_sql()
    head = full[:full.index(",\ns3 AS")]
    return head + """
SELECT row_key, priority, round(price_text, 4) AS price_text, round(price, 4) AS price, email, status,
  CAST(ordered_at AS VARCHAR) AS ordered_at, copy_no FROM s2"""


QUERIES["recipe_version"] = (q_recipe_version, _version_sql())


def _plan_sql() -> str:
    """J12 plan for ``orders``: the same candidates and scores in SQL, ordered
    by score with the planner's insertion order breaking ties."""
    nums = ["o_orderkey", "o_custkey", "o_totalprice"]
    cats = ["o_orderstatus", "o_orderpriority"]
    parts = ["SELECT 0 AS seq, 'heatmap' AS type, 'ALL_NUMERICAL' AS x, 'ALL_NUMERICAL' AS y, 95 AS score"]
    seq = 1
    for i, a in enumerate(nums):
        for b in nums[i + 1:]:
            r = f"coalesce(round(corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)), 2), 0)"
            parts.append(f"SELECT {seq}, 'scatter', {S.lit(a)}, {S.lit(b)}, CAST(floor(70 + abs({r}) * 30) AS INTEGER) "
                         f"FROM orders HAVING abs({r}) >= 0.15")
            seq += 1
    for c in nums:
        parts.append(f"SELECT {seq}, 'histogram', {S.lit(c)}, 'count', 85 FROM orders HAVING count({c}) > 0")
        seq += 1
    for i, c in enumerate(cats):
        u = f"count(DISTINCT {c})"
        kind = f"CASE WHEN {u} <= 6 THEN {S.lit('pie' if i % 2 == 0 else 'donut')} ELSE 'bar' END"
        parts.append(f"SELECT {seq}, {kind}, {S.lit(c)}, 'count', 80 FROM orders HAVING {u} > 1 AND {u} <= 50")
        seq += 1
    for i, y in enumerate(nums):
        parts.append(f"""SELECT {seq}, {S.lit('area' if i % 2 == 0 else 'line')}, 'o_orderdate', {S.lit(y)},
  CAST(floor(80 + least(20, cv * 50)) AS INTEGER) FROM (
  WITH b AS (SELECT date_trunc('month', min(o_orderdate)) AS a, date_trunc('month', max(o_orderdate)) AS z FROM orders),
  sp AS (SELECT last_day(CAST(m AS DATE)) AS month FROM b, generate_series(b.a, b.z, INTERVAL 1 MONTH) t(m)),
  g AS (SELECT last_day(CAST(o_orderdate AS DATE)) AS month, avg({y}) AS v FROM orders WHERE o_orderdate IS NOT NULL GROUP BY 1),
  m AS (SELECT sp.month, g.v FROM sp LEFT JOIN g USING (month)),
  s AS (SELECT count(*) AS months, arg_min(v, month) AS f, arg_max(v, month) AS l, stddev_samp(v) AS sd, avg(v) AS mu FROM m)
  SELECT months, CASE WHEN mu <> 0 THEN abs(sd / mu) ELSE 0 END AS cv,
         CASE WHEN f IS NOT NULL AND f <> 0 THEN (l - f) / f * 100 ELSE 0 END AS chg FROM s)
WHERE months >= 2 AND NOT (coalesce(cv, 0) < 0.05 AND abs(chg) < 5)""")
        seq += 1
    for i in range(len(cats)):
        for j in range(i + 1, len(cats)):
            x, y = cats[i], cats[j]
            kind = "stacked_bar" if (i + j) % 2 == 0 else "grouped_bar"
            parts.append(f"SELECT {seq}, {S.lit(kind)}, {S.lit(x)}, {S.lit(y)}, 75 FROM orders "
                         f"HAVING count(DISTINCT {y}) <= 10 AND count(DISTINCT {x}) <= 15 "
                         f"AND count(DISTINCT {x}) BETWEEN 2 AND 50 AND count(DISTINCT {y}) BETWEEN 2 AND 50")
            seq += 1
    for x in cats:
        for y in nums:
            parts.append(f"""SELECT {seq}, 'bar', {S.lit(x)}, {S.lit(y)}, CAST(floor(75 + least(25, abs(cv) * 20)) AS INTEGER)
FROM (SELECT stddev_samp(m) / avg(m) AS cv, (SELECT count(DISTINCT {x}) FROM orders) AS u FROM (
  SELECT avg({y}) AS m FROM orders WHERE {x} IS NOT NULL GROUP BY {x} HAVING avg({y}) IS NOT NULL
  ORDER BY m DESC, {x} LIMIT 20)) WHERE u BETWEEN 2 AND 20 AND abs(coalesce(cv, 0)) > 0.05""")
            seq += 1
    body = "\nUNION ALL\n".join(parts)
    return f"""SELECT CAST(row_number() OVER (ORDER BY least(score, 100) DESC, seq) AS INTEGER) AS rank, type, x, y,
  CAST(least(score, 100) AS INTEGER) AS score FROM ({body})"""


QUERIES["chart_plan"] = (q_chart_plan, _plan_sql())


def q_auto_slicers(spark, sf):
    """E33, auto-dashboard variant, on orders."""
    s = auto_slicers(table(spark, sf, "orders"))
    return s.select("column", "type", F.concat_ws("|", "options").alias("options"), "min", "max")


SQL_AUTO_SLICERS = """SELECT 'o_orderstatus' AS "column", 'category' AS type,
  (SELECT string_agg(v, '|' ORDER BY v) FROM (SELECT DISTINCT o_orderstatus AS v FROM orders WHERE o_orderstatus IS NOT NULL)) AS options,
  CAST(NULL AS DOUBLE) AS min, CAST(NULL AS DOUBLE) AS max
UNION ALL SELECT 'o_orderpriority', 'category',
  (SELECT string_agg(v, '|' ORDER BY v) FROM (SELECT DISTINCT o_orderpriority AS v FROM orders WHERE o_orderpriority IS NOT NULL)),
  NULL, NULL
UNION ALL SELECT 'o_totalprice', 'numeric', '', min(o_totalprice), max(o_totalprice) FROM orders
  HAVING min(o_totalprice) <> max(o_totalprice)"""

QUERIES["auto_slicers"] = (q_auto_slicers, SQL_AUTO_SLICERS)


def q_recommend_duplicates(spark, sf):
    """J14 where rows repeat: the whole rows of the dirty table without their copy number."""
    from .recommend import recommend
    return recommend(Analysis(dirty_orders(spark, sf).drop("copy_no"))).where(F.col("issue") == "Exact Duplicates")


QUERIES["recommend_duplicates"] = (q_recommend_duplicates, dirty_cte("""SELECT 'all' AS "column", 'Exact Duplicates' AS issue,
  'Remove Exact Duplicates' AS method FROM dirty_orders HAVING count(*) > count(DISTINCT row_key)"""))


def q_auto_insights(spark, sf):
    """What the auto-dashboard says about orders."""
    from ..operators.dashboard import auto_insights
    return auto_insights(table(spark, sf, "orders")).select("kind", "column", F.round("value", 4).alias("value"))


QUERIES["auto_insights"] = (q_auto_insights, """SELECT 'records' AS kind, CAST(NULL AS VARCHAR) AS "column",
  CAST(count(*) AS DOUBLE) AS value FROM orders
UNION ALL SELECT 'dominant', 'o_orderstatus', CAST(max(n) AS DOUBLE) FROM (SELECT count(*) AS n FROM orders GROUP BY o_orderstatus)
UNION ALL SELECT 'average', 'o_totalprice', round(avg(o_totalprice), 4) FROM orders""")
