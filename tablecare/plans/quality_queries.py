"""Registered queries, phases 1-2: predicates, profile, typing, flags.

Each entry is ``name -> (spark_fn, oracle_sql)``; ``spark_fn(spark, sf_dir)``
returns a DataFrame over the whole given tables, ``oracle_sql`` restates the
same result for DuckDB.  Doubles are rounded identically on both sides.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.analysis import Analysis
from ..operators.duplicates import duplicate_groups
from ..operators.infer import type_evidence
from ..operators.profile import profile
from . import sqlgen as S
from .views import DIRTY_KEYS, DIRTY_ORDER, dirty_cte, dirty_orders, table

LINEITEM_NUMS = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
                 "l_extendedprice", "l_discount", "l_tax")
ORDERS_NUMS = ("o_orderkey", "o_custkey", "o_totalprice")
# kind of each dirty_orders column for the SQL side: text / float / int / other
DIRTY_KINDS = {"row_key": "int", "priority": "text", "price_text": "text", "price": "float",
               "email": "text", "status": "text", "ordered_at": "other", "copy_no": "int"}
DIRTY_PROMOTED = ("price_text",)
DIRTY_NUMERIC = ("row_key", "price_text", "price", "copy_no")


def r(c, d=4):
    return F.round(F.col(c), d).alias(c)


# ---------------------------------------------------------------- profile ---
def q_profile_numeric(spark, sf):
    li = table(spark, sf, "lineitem")
    p = profile(li, list(LINEITEM_NUMS))
    return p.select("column", "n", "nulls", r("mean"), r("std"), "min", "max", r("median"),
                    "q1", "q3", "p5", "p90", "p95", r("skew", 6), "distinct")


def _num_profile_sql(tbl: str, c: str) -> str:
    x = "x"
    skew = "avg(power(x - m, 3)) / power(avg(power(x - m, 2)), 1.5)"
    return (f"SELECT {S.lit(c)} AS \"column\", count(x) AS n, count(*) - count(x) AS nulls, "
            f"round(avg(x), 4) AS mean, round(stddev_samp(x), 4) AS std, min(x) AS min, max(x) AS max, "
            f"round(median(x), 4) AS median, {S.nearest(x, 0.25)} AS q1, {S.nearest(x, 0.75)} AS q3, "
            f"{S.nearest(x, 0.05)} AS p5, {S.nearest(x, 0.9)} AS p90, {S.nearest(x, 0.95)} AS p95, "
            f"round({skew}, 6) AS skew, count(DISTINCT x) + CAST(count(*) > count(x) AS BIGINT) AS \"distinct\" "
            f"FROM (SELECT x, avg(x) OVER () AS m FROM (SELECT CAST({S.q(c)} AS DOUBLE) + 0.0 AS x FROM {tbl}))")


SQL_PROFILE_NUMERIC = "\nUNION ALL\n".join(_num_profile_sql("lineitem", c) for c in LINEITEM_NUMS)


# ------------------------------------------------------- missing / empty ---
def q_missing_empty_by_col(spark, sf):
    a = Analysis(dirty_orders(spark, sf))
    p = a.profile_df
    pct = F.col("missing") / F.col("rows") * 100
    sev = (F.when(pct < 5, "Low").when(pct <= 20, "Medium").when(pct <= 50, "High").otherwise("Critical"))
    return p.select("column", "missing", "empty", "valid",
                    F.round(pct, 2).alias("missing_pct"),
                    F.round(F.col("empty") / F.col("rows") * 100, 2).alias("empty_pct"),
                    sev.alias("severity"))


def _missing_sql(c, kind):
    x = S.q(c)
    m, e = S.missing(x, kind), S.empty(x, kind)
    pct = f"(count_if({m}) / count(*) * 100)"
    return (f"SELECT {S.lit(c)} AS \"column\", count_if({m}) AS missing, count_if({e}) AS empty, "
            f"count(*) - count_if({m}) - count_if({e}) AS valid, round({pct}, 2) AS missing_pct, "
            f"round(count_if({e}) / count(*) * 100, 2) AS empty_pct, "
            f"CASE WHEN {pct} < 5 THEN 'Low' WHEN {pct} <= 20 THEN 'Medium' WHEN {pct} <= 50 THEN 'High' "
            f"ELSE 'Critical' END AS severity FROM dirty_orders")


SQL_MISSING_EMPTY = dirty_cte("\nUNION ALL\n".join(_missing_sql(c, k) for c, k in DIRTY_KINDS.items()))


# ------------------------------------------------------------- promotion ---
def q_promote_numeric(spark, sf):
    ev = type_evidence(dirty_orders(spark, sf))
    return ev.select("column", "valid", "numeric_valid", F.round("numeric_share", 4).alias("numeric_share"),
                     "promoted", "pattern")


def _promo_sql(c):
    x = S.q(c)
    v, nb = S.valid(x, "text"), S.nonblank(x)
    share = f"(count_if({v} AND {S.matches(x, 'numeric')}) / nullif(count_if({v}), 0))"
    pats = " ".join(f"WHEN count_if({nb}) > 0 AND count_if({nb} AND {S.matches(x, k)}) / count_if({nb}) > 0.8 "
                    f"THEN {S.lit(k)}" for k in ("numeric", "email", "phone"))
    return (f"SELECT {S.lit(c)} AS \"column\", count_if({v}) AS valid, "
            f"count_if({v} AND {S.matches(x, 'numeric')}) AS numeric_valid, round({share}, 4) AS numeric_share, "
            f"coalesce({share} >= 0.9, false) AS promoted, "
            f"CASE WHEN coalesce({share} >= 0.9, false) THEN 'numeric' {pats} END AS pattern FROM dirty_orders")


SQL_PROMOTE = dirty_cte("\nUNION ALL\n".join(_promo_sql(c) for c, k in DIRTY_KINDS.items() if k == "text"))


# --------------------------------------------------------------- outliers ---
def _outlier_result(a: Analysis):
    counts = a.issue_counts().select("column", "outliers")
    rules = a.outlier_table()
    return (rules.join(counts, "column")
                 .select("column", "method", r("lower"), r("upper"), "outliers"))


def q_outliers_iqr(spark, sf):
    return _outlier_result(Analysis(table(spark, sf, "orders")))


def q_outliers_zscore(spark, sf):
    return _outlier_result(Analysis(table(spark, sf, "lineitem")))


def outlier_stats_sql(src: str, c: str, expr: str | None = None) -> str:
    """One row ``(column, n, q1, q3, mean, std, skew)`` for a numeric column."""
    e = expr or f"CAST({S.q(c)} AS DOUBLE)"
    return (f"SELECT {S.lit(c)} AS col, count(x) AS n, {S.nearest('x', 0.25)} AS q1, {S.nearest('x', 0.75)} AS q3, "
            f"avg(x) AS mean, stddev_samp(x) AS std, "
            f"avg(power(x - m, 3)) / power(avg(power(x - m, 2)), 1.5) AS skew "
            f"FROM (SELECT x, avg(x) OVER () AS m FROM (SELECT {e} + 0.0 AS x FROM {src}))")


def outlier_rules_sql(src: str, cols: dict[str, str]) -> str:
    """``(col, method, lower, upper, mean, std)`` per numeric column."""
    stats = "\nUNION ALL\n".join(outlier_stats_sql(src, c, e) for c, e in cols.items())
    return f"""SELECT col,
  CASE WHEN n < 10 THEN NULL
       WHEN n > 50000 AND abs(skew) < 0.5 THEN (CASE WHEN std > 0 THEN 'Z-Score' ELSE 'None' END)
       ELSE 'IQR' END AS method,
  CASE WHEN n < 10 THEN NULL WHEN n > 50000 AND abs(skew) < 0.5 THEN (CASE WHEN std > 0 THEN mean - 3 * std END)
       ELSE q1 - 1.5 * (q3 - q1) END AS lower,
  CASE WHEN n < 10 THEN NULL WHEN n > 50000 AND abs(skew) < 0.5 THEN (CASE WHEN std > 0 THEN mean + 3 * std END)
       ELSE q3 + 1.5 * (q3 - q1) END AS upper,
  mean, std
FROM ({stats})"""


def outlier_pred_sql(x: str, rule: str) -> str:
    """Outlier predicate against a joined rule row aliased ``rule``."""
    return (f"(CASE WHEN {rule}.method = 'IQR' THEN ({x} < {rule}.lower OR {x} > {rule}.upper) "
            f"WHEN {rule}.method = 'Z-Score' THEN abs(({x} - {rule}.mean) / {rule}.std) > 3 ELSE false END)")


def _outlier_sql(tbl, cols):
    rules = outlier_rules_sql(tbl, {c: None for c in cols})
    counts = "\nUNION ALL\n".join(
        f"SELECT {S.lit(c)} AS col, count_if(coalesce({outlier_pred_sql('CAST(t.' + S.q(c) + ' AS DOUBLE)', 'rr')}, false)) AS outliers "
        f"FROM {tbl} t LEFT JOIN rules rr ON rr.col = {S.lit(c)}" for c in cols)
    return (f"WITH rules AS ({rules}), counts AS ({counts})\n"
            f"SELECT rules.col AS \"column\", method, round(lower, 4) AS lower, round(upper, 4) AS upper, outliers "
            f"FROM rules JOIN counts USING (col)")


SQL_OUTLIERS_IQR = _outlier_sql("orders", ORDERS_NUMS)
SQL_OUTLIERS_Z = _outlier_sql("lineitem", LINEITEM_NUMS)


# ------------------------------------------------------------- duplicates ---
def q_dup_groups(spark, sf):
    d = dirty_orders(spark, sf)
    a = Analysis(d)
    g = duplicate_groups(a.typed, keys=list(DIRTY_KEYS), order_by=list(DIRTY_ORDER))
    return g.select("first_row_id", "group_rows", F.concat_ws(",", F.col("duplicate_row_ids").cast("array<string>"))
                    .alias("duplicate_row_ids"), "total_duplicates")


def dirty_norm_sql(c: str) -> str:
    """Normalised duplicate key of a dirty_orders column (after promotion)."""
    k = DIRTY_KINDS[c]
    x = S.q(c)
    if c in DIRTY_PROMOTED:
        return f"({S.numeral(x)} + 0.0)"
    if k == "text":
        return f"(CASE WHEN lower({S.strip(x)}) NOT IN ({S.TOKENS}) THEN {S.strip(x)} END)"
    if k in ("int", "float"):
        return f"(CAST({x} AS DOUBLE) + 0.0)"
    return x


def _dup_groups_sql():
    keys = ", ".join(f"{dirty_norm_sql(c)} AS k_{c}" for c in DIRTY_KEYS)
    kcols = ", ".join(f"k_{c}" for c in DIRTY_KEYS)
    on = " AND ".join(f"d.k_{c} IS NOT DISTINCT FROM g.k_{c}" for c in DIRTY_KEYS)
    return dirty_cte(f"""
, d AS (SELECT row_number() OVER (ORDER BY row_key, copy_no) - 1 AS rid, {keys} FROM dirty_orders),
g AS (SELECT {kcols}, count(*) AS group_rows, min(rid) AS first_row_id FROM d GROUP BY {kcols}
      HAVING count(*) > 1 ORDER BY first_row_id LIMIT 100),
m AS (SELECT g.first_row_id, d.rid, row_number() OVER (PARTITION BY g.first_row_id ORDER BY d.rid) AS rn
      FROM d JOIN g ON {on} WHERE d.rid <> g.first_row_id)
SELECT g.first_row_id, g.group_rows,
  (SELECT string_agg(CAST(rid AS VARCHAR), ',' ORDER BY rid) FROM m WHERE m.first_row_id = g.first_row_id AND rn <= 5)
    AS duplicate_row_ids,
  g.group_rows - 1 AS total_duplicates
FROM g""")


def q_col_dup_counts(spark, sf):
    a = Analysis(dirty_orders(spark, sf))
    return a.profile_df.select("column", F.col("dup_cells"),
                               F.round(F.col("dup_cells") / F.col("rows") * 100, 2).alias("dup_pct"))


def _col_dup_sql():
    parts = []
    for c in DIRTY_KINDS:
        x = S.numeral(S.q(c)) if c in DIRTY_PROMOTED else (
            f"CAST({S.q(c)} AS DOUBLE) + 0.0" if DIRTY_KINDS[c] in ("int", "float") else S.q(c))
        parts.append(f"SELECT {S.lit(c)} AS \"column\", CAST(coalesce(sum(n) FILTER (WHERE n > 1), 0) AS BIGINT) AS dup_cells, "
                     f"round(coalesce(sum(n) FILTER (WHERE n > 1), 0) / sum(n) * 100, 2) AS dup_pct "
                     f"FROM (SELECT count(*) AS n FROM (SELECT {x} AS v FROM dirty_orders) GROUP BY v)")
    return dirty_cte("\nUNION ALL\n".join(parts))


# ---------------------------------------------------- invalid / categories ---
def q_invalid_types(spark, sf):
    a = Analysis(dirty_orders(spark, sf))
    pats = a.plan.pattern
    rows = [(c, k) for c, k in pats.items()]
    exp = a.raw.sparkSession.createDataFrame(rows, "column string, expected string")
    return (exp.join(a.issue_counts().select("column", F.col("invalid").alias("mismatches")), "column")
               .where(F.col("mismatches") > 0))


def _invalid_sql():
    # email is the only text column whose non-blank cells follow a pattern > 80 %
    x = S.q("email")
    inv = f"{S.nonblank(x)} AND NOT {S.missing(x, 'text')} AND NOT {S.matches(x, 'email')}"
    n = f"count_if({S.nonblank(x)})"
    return dirty_cte(
        f"SELECT 'email' AS \"column\", 'email' AS expected, count_if({inv}) AS mismatches FROM dirty_orders "
        f"HAVING count_if({S.nonblank(x)} AND {S.matches(x, 'email')}) / {n} > 0.8 AND count_if({inv}) > 0")


def q_inconsistent_cats(spark, sf):
    return Analysis(dirty_orders(spark, sf)).category_table


def inconsistent_sql(src: str, c: str) -> str:
    """``(column, value, dominant, n)`` for one text column."""
    x = S.q(c)
    return f"""SELECT {S.lit(c)} AS "column", v AS value, dominant, n FROM (
  SELECT v, n, first(v ORDER BY n DESC, v ASC) OVER (PARTITION BY lower(v)) AS dominant,
         count(*) OVER () AS uniq, count(DISTINCT lower(v)) OVER () AS luniq
  FROM (SELECT {x} AS v, count(*) AS n FROM {src} WHERE {S.nonblank(x)} GROUP BY {x}))
WHERE uniq < 1000 AND luniq < uniq AND v <> dominant"""


SQL_INCONSISTENT = dirty_cte("\nUNION ALL\n".join(
    inconsistent_sql("dirty_orders", c) for c, k in DIRTY_KINDS.items() if k == "text" and c not in DIRTY_PROMOTED))


# ------------------------------------------------------------- flag table ---
def q_flag_table(spark, sf):
    f = Analysis(dirty_orders(spark, sf), dup_keys=list(DIRTY_KEYS)).flag_frame()
    arr = lambda c: F.concat_ws(",", F.col(c)).alias(c)
    return f.select("row_key", "copy_no", "_is_duplicate", arr("_outlier_cols"), arr("_empty_cols"),
                    arr("_missing_cols"), arr("_invalid_type_cols"), arr("_inconsistent_category_cols"))


def _flag_sql():
    cols = {c: (S.numeral(S.q(c)) if c in DIRTY_PROMOTED else f"CAST({S.q(c)} AS DOUBLE)") for c in DIRTY_NUMERIC}
    rules = outlier_rules_sql("dirty_orders", cols)
    joins = " ".join(f"LEFT JOIN rules r_{c} ON r_{c}.col = {S.lit(c)}" for c in DIRTY_NUMERIC)
    outl = ", ".join(f"CASE WHEN coalesce({outlier_pred_sql(cols[c].replace(S.q(c), 'd.' + S.q(c)), 'r_' + c)}, false) "
                     f"THEN {S.lit(c)} END" for c in DIRTY_NUMERIC)
    miss = ", ".join(f"CASE WHEN {S.missing('d.' + S.q(c), k if k != 'other' else 'int')} THEN {S.lit(c)} END"
                     for c, k in DIRTY_KINDS.items())
    emp = ", ".join(f"CASE WHEN {S.empty('d.' + S.q(c), k)} THEN {S.lit(c)} END" for c, k in DIRTY_KINDS.items())
    x = "d.email"
    inv = (f"CASE WHEN {S.nonblank(x)} AND NOT {S.missing(x, 'text')} AND NOT {S.matches(x, 'email')} "
           f"THEN 'email' END")
    pt = "d.price_text"
    dup_keys = ", ".join(dirty_norm_sql(c).replace(S.q(c), "d." + S.q(c)) for c in DIRTY_KEYS)
    inv_p = f"CASE WHEN {S.valid(pt, 'text')} AND NOT {S.matches(pt, 'numeric')} THEN 'price_text' END"
    return dirty_cte(f"""
, rules AS ({rules}),
cats AS ({inconsistent_sql('dirty_orders', 'priority')})
SELECT d.row_key, d.copy_no, count(*) OVER (PARTITION BY {dup_keys}) > 1 AS _is_duplicate,
  concat_ws(',', {outl}) AS _outlier_cols,
  concat_ws(',', {emp}) AS _empty_cols,
  concat_ws(',', {miss}) AS _missing_cols,
  concat_ws(',', {inv_p}, {inv}) AS _invalid_type_cols,
  concat_ws(',', CASE WHEN d.priority IN (SELECT value FROM cats) THEN 'priority' END) AS _inconsistent_category_cols
FROM dirty_orders d {joins}""")


QUERIES = {
    "profile_numeric": (q_profile_numeric, SQL_PROFILE_NUMERIC),
    "missing_empty_by_col": (q_missing_empty_by_col, SQL_MISSING_EMPTY),
    "promote_numeric": (q_promote_numeric, SQL_PROMOTE),
    "outliers_iqr": (q_outliers_iqr, SQL_OUTLIERS_IQR),
    "outliers_zscore": (q_outliers_zscore, SQL_OUTLIERS_Z),
    "dup_groups": (q_dup_groups, _dup_groups_sql()),
    "col_dup_counts": (q_col_dup_counts, _col_dup_sql()),
    "invalid_types": (q_invalid_types, _invalid_sql()),
    "inconsistent_cats": (q_inconsistent_cats, SQL_INCONSISTENT),
    "flag_table": (q_flag_table, _flag_sql()),
}


# ---------------------------------------------------------- outlier extremes ---
def q_outlier_extremes(spark, sf):
    from ..operators.analysis import outlier_extremes
    from ..operators.classify import quality_classes
    a = Analysis(dirty_orders(spark, sf))
    cls = quality_classes(a.profile_df, a.date_shares)
    numeric = [r["column"] for r in cls.where(F.col("class") == "Numeric").select("column").collect()]
    return outlier_extremes(a, numeric)


def _extremes_sql():
    cols = {c: (S.numeral(S.q(c)) if c in DIRTY_PROMOTED else f"CAST({S.q(c)} AS DOUBLE)")
            for c in ("price_text", "price", "copy_no")}   # the Numeric-class columns (checked by column_classes)
    rules = outlier_rules_sql("dirty_orders", cols)
    cells = "\nUNION ALL\n".join(
        f"SELECT {list(DIRTY_KINDS).index(c)} AS p, {S.lit(c)} AS c, v FROM (SELECT {e} AS v FROM dirty_orders) t "
        f"LEFT JOIN rules r ON r.col = {S.lit(c)} WHERE coalesce({outlier_pred_sql('v', 'r')}, false)"
        for c, e in cols.items())
    return dirty_cte(f""", rules AS ({rules}), cells AS ({cells})
SELECT (SELECT c FROM cells ORDER BY v, p LIMIT 1) AS minimum_outlier_column, (SELECT min(v) FROM cells) AS minimum_outlier_value,
  (SELECT c FROM cells ORDER BY v DESC, p LIMIT 1) AS largest_outlier_column, (SELECT max(v) FROM cells) AS largest_outlier_value""")


QUERIES["outlier_extremes"] = (q_outlier_extremes, _extremes_sql())


# ---------------------------------------------- duplicates of whole rows ---
def q_keep_first_unordered(spark, sf):
    """H1/F5 without order keys, on a shuffled frame: whole rows, normalised."""
    from ..operators.clean import clean
    d = dirty_orders(spark, sf).drop("copy_no").repartition(7, "status", "row_key")
    return clean(Analysis(d), "Duplicate Rows", ["all"], "Keep First").select("row_key", "email", "status")


QUERIES["keep_first_unordered"] = (q_keep_first_unordered, dirty_cte("SELECT DISTINCT row_key, email, status FROM dirty_orders"))


def q_exact_duplicate_keys(spark, sf):
    """E10 on integers above 2^53 and decimals that differ in the last place only."""
    d = table(spark, sf, "orders").selectExpr("o_custkey + 9007199254740992 AS big", "CAST(o_totalprice AS DECIMAL(20, 2)) AS price")
    return Analysis(d).duplicate_rows_total()


QUERIES["exact_duplicate_keys"] = (q_exact_duplicate_keys, """SELECT CAST(coalesce(sum(n), 0) AS BIGINT) AS duplicate_rows,
  count(*) AS duplicate_groups FROM (SELECT count(*) AS n FROM (
    SELECT o_custkey + 9007199254740992 AS big, CAST(o_totalprice AS DECIMAL(20, 2)) AS price FROM orders)
  GROUP BY big, price) WHERE n > 1""")


def q_date_share_all_cells(spark, sf):
    """C1's date evidence over all cells: a text column that is a date in one row of ten,
    and one that is a date in every row."""
    d = table(spark, sf, "orders").selectExpr(
        "CASE WHEN o_orderkey % 10 = 1 THEN date_format(o_orderdate, 'yyyy-MM-dd') ELSE o_orderpriority END AS mixed",
        "date_format(o_orderdate, 'yyyy-MM-dd') AS day_text")
    return Analysis(d).date_shares.select("column", F.round("date_share", 6).alias("date_share"))


QUERIES["date_share_all_cells"] = (q_date_share_all_cells, """SELECT 'mixed' AS "column",
  round(count_if(o_orderkey % 10 = 1) / count(*), 6) AS date_share FROM orders UNION ALL SELECT 'day_text', 1.0""")


def q_outlier_report(spark, sf):
    """Outlier counts and shares of the dirty table's numeric columns."""
    from ..operators.analysis import outlier_report
    return outlier_report(Analysis(dirty_orders(spark, sf))).select("column", "outliers", "outlier_pct")


def _outlier_report_sql():
    cols = {c: (S.numeral(S.q(c)) if c in DIRTY_PROMOTED else f"CAST({S.q(c)} AS DOUBLE)") for c in DIRTY_NUMERIC}
    parts = "\nUNION ALL\n".join(
        f"SELECT {S.lit(c)} AS \"column\", count_if(coalesce({outlier_pred_sql('v', 'r')}, false)) AS outliers, count(*) AS n "
        f"FROM (SELECT {e} AS v FROM dirty_orders) t LEFT JOIN rules r ON r.col = {S.lit(c)}" for c, e in cols.items())
    return dirty_cte(f""", rules AS ({outlier_rules_sql("dirty_orders", cols)})
SELECT "column", outliers, round(outliers / n * 100, 2) AS outlier_pct FROM ({parts}) WHERE outliers > 0""")


QUERIES["outlier_report"] = (q_outlier_report, _outlier_report_sql())
