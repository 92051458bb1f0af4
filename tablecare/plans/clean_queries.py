"""Registered queries, phases 3-4: cleaning steps on ``dirty_orders``.

Every query analyses the dirty view (typing, profile), applies one named step
and returns the whole cleaned table.  Order-dependent steps use the row order
``(row_key, copy_no)``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import predicates as P
from ..operators.analysis import Analysis
from ..operators.clean import clean
from . import sqlgen as S
from .quality_queries import DIRTY_KINDS, DIRTY_PROMOTED, outlier_rules_sql
from .views import DIRTY_KEYS, DIRTY_ORDER, dirty_cte, dirty_orders, table

OUT_COLS = ("row_key", "priority", "price_text", "price", "email", "status", "ordered_at", "copy_no")


def shape(df: DataFrame) -> DataFrame:
    """Stable output: doubles rounded to 4 places, timestamps as text."""
    sel = []
    for f in df.schema.fields:
        if P.is_float(f.dataType):
            sel.append(F.round(F.col(f.name), 4).alias(f.name))
        elif P.is_date(f.dataType):
            sel.append(F.col(f.name).cast("string").alias(f.name))
        else:
            sel.append(F.col(f.name))
    return df.select(*sel)


def step(issue, cols, method, custom=None):
    def run(spark, sf):
        a = Analysis(dirty_orders(spark, sf))
        return shape(clean(a, issue, list(cols), method, custom, order_by=list(DIRTY_ORDER)))
    return run


# ------------------------------------------------------------------ SQL ---
TYPED = dirty_cte(""", typed AS (
  SELECT row_key, priority, """ + S.numeral("price_text") + """ AS price_text, price, email, status, ordered_at,
         copy_no, price_text AS price_text_raw,
         row_number() OVER (ORDER BY row_key, copy_no) - 1 AS rid
  FROM dirty_orders)""")


def kind(c):
    return "float" if c in DIRTY_PROMOTED else DIRTY_KINDS[c]


def text_of(c):
    return "price_text_raw" if c in DIRTY_PROMOTED else S.q(c)


def miss(c):
    k = "text" if c in DIRTY_PROMOTED else DIRTY_KINDS[c]
    return S.missing(text_of(c), k if k != "other" else "int")


def emp(c):
    k = "text" if c in DIRTY_PROMOTED else DIRTY_KINDS[c]
    return S.empty(text_of(c), k)


def usable(c):
    return f"(NOT {miss(c)} AND NOT {emp(c)} AND {S.q(c)} IS NOT NULL)"


def out_sql(exprs: dict[str, str], where: str = "true", src: str = "typed", cols=OUT_COLS) -> str:
    sel = []
    for c in cols:
        e = exprs.get(c, S.q(c))
        k = DIRTY_KINDS[c]
        if c in DIRTY_PROMOTED or k == "float":
            sel.append(f"round(CAST({e} AS DOUBLE), 4) AS {c}")
        elif k == "other":
            sel.append(f"CAST({e} AS VARCHAR) AS {c}")
        else:
            sel.append(f"{e} AS {c}")
    return f"SELECT {', '.join(sel)} FROM {src} WHERE {where}"


def stat(c, name):
    x = S.q(c)
    if name == "mean":
        return f"(SELECT avg({x}) FROM typed WHERE NOT isnan({x}))"
    if name == "median":
        return f"(SELECT median({x}) FROM typed WHERE NOT isnan({x}))"
    if name in ("q1", "q3", "p5", "p90", "p95"):
        qv = {"q1": 0.25, "q3": 0.75, "p5": 0.05, "p90": 0.9, "p95": 0.95}[name]
        return f"(SELECT {S.nearest(x, qv)} FROM typed)"
    if name == "mode":
        if DIRTY_KINDS[c] == "text" and c not in DIRTY_PROMOTED:
            cond = S.valid(x, "text")
        else:
            cond = f"{x} IS NOT NULL AND NOT isnan({x})"
        return f"(SELECT v FROM (SELECT {x} AS v, count(*) AS n FROM typed WHERE {cond} GROUP BY {x}) ORDER BY n DESC, v LIMIT 1)"
    raise ValueError(name)


def fill_stat_sql(cols, pred, name):
    return TYPED + "\n" + out_sql({c: f"CASE WHEN {pred(c)} THEN {stat(c, name)} ELSE {S.q(c)} END" for c in cols})


def ffill_sql(cols, pred, direction):
    frame = ("ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW" if direction == "previous"
             else "ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING")
    fn = "last_value" if direction == "previous" else "first_value"
    ex = {c: (f"CASE WHEN {pred(c)} THEN {fn}(CASE WHEN {usable(c)} THEN {S.q(c)} END IGNORE NULLS) "
              f"OVER (ORDER BY rid {frame}) ELSE {S.q(c)} END") for c in cols}
    return TYPED + "\n" + out_sql(ex)


def interp_sql(cols, pred):
    ex = {}
    for c in cols:
        x, u = S.q(c), usable(c)
        pv = f"last_value(CASE WHEN {u} THEN {x} END IGNORE NULLS) OVER (ORDER BY rid ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
        pi = f"last_value(CASE WHEN {u} THEN rid END IGNORE NULLS) OVER (ORDER BY rid ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
        nv = f"first_value(CASE WHEN {u} THEN {x} END IGNORE NULLS) OVER (ORDER BY rid ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
        ni = f"first_value(CASE WHEN {u} THEN rid END IGNORE NULLS) OVER (ORDER BY rid ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
        ex[c] = (f"CASE WHEN {pred(c)} THEN (CASE WHEN ({ni}) = ({pi}) THEN ({pv}) ELSE "
                 f"({pv}) + (({nv}) - ({pv})) * (CAST(rid - ({pi}) AS DOUBLE) / CAST(({ni}) - ({pi}) AS DOUBLE)) END) "
                 f"ELSE {x} END")
    return TYPED + "\n" + out_sql(ex)


def custom_sql(cols, pred, value):
    ex = {}
    for c in cols:
        if c in DIRTY_PROMOTED or DIRTY_KINDS[c] in ("int", "float"):
            try:
                v = f"CAST({float(value)} AS DOUBLE)"
            except (TypeError, ValueError):
                v = "CAST(NULL AS DOUBLE)"
        else:
            v = S.lit(value or "Unknown")
        ex[c] = f"CASE WHEN {pred(c)} THEN {v} ELSE {S.q(c)} END"
    return TYPED + "\n" + out_sql(ex)


def bounds_cte(c):
    rules = outlier_rules_sql("typed", {c: S.q(c)})
    return f", rule_{c} AS ({rules})"


def outlier_sql(c, method):
    """Cleaning uses ``lower/upper`` of the column's rule (IQR or z bounds)."""
    x = S.q(c)
    lo, hi = f"(SELECT lower FROM rule_{c})", f"(SELECT upper FROM rule_{c})"
    out = f"({x} < {lo} OR {x} > {hi})"
    head = TYPED + bounds_cte(c) + "\n"
    if method == "remove":
        return head + out_sql({}, f"(NOT coalesce({out}, false) OR {x} IS NULL)")
    if method == "cap":
        return head + out_sql({c: f"CASE WHEN {x} > {hi} THEN {hi} WHEN {x} < {lo} THEN {lo} ELSE {x} END"})
    if method == "winsor":
        p5, p95 = stat(c, "p5"), stat(c, "p95")
        return head + out_sql({c: f"CASE WHEN {x} > {p95} THEN {p95} WHEN {x} < {p5} THEN {p5} ELSE {x} END"})
    if method == "zclip":
        m, s = f"(SELECT avg({x}) FROM typed)", f"(SELECT stddev_samp({x}) FROM typed)"
        return head + out_sql({c: f"CASE WHEN {x} > {m} + 3 * {s} THEN {m} + 3 * {s} "
                                  f"WHEN {x} < {m} - 3 * {s} THEN {m} - 3 * {s} ELSE {x} END"})
    return head + out_sql({c: f"CASE WHEN {out} THEN {stat(c, method)} ELSE {x} END"})


def keep_sql(which):
    part = ", ".join(S.q(c) for c in DIRTY_KEYS)
    order = "rid ASC" if which == "first" else "rid DESC"
    return TYPED + f""", ranked AS (SELECT *, row_number() OVER (PARTITION BY {part} ORDER BY {order}) AS rn FROM typed)
""" + out_sql({}, "rn = 1", "ranked")


def where_not_any(pred, cols):
    return " AND ".join(f"NOT {pred(c)}" for c in cols)


TRIM_COLS = [c for c, k in DIRTY_KINDS.items() if k == "text" and c not in DIRTY_PROMOTED]


def q_clean_dates(spark, sf):
    """Date texts in mixed formats derived from ``orders`` unified to timestamps."""
    o = table(spark, sf, "orders")
    k = F.col("o_orderkey") % 4
    txt = (F.when(k == 0, F.date_format("o_orderdate", "yyyy-MM-dd"))
            .when(k == 1, F.date_format("o_orderdate", "MM/dd/yyyy"))
            .when(k == 2, F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"))
            .otherwise(F.concat(F.lit("x"), F.col("o_orderkey").cast("string"))))
    d = o.select("o_orderkey", txt.alias("when_text"))
    a = Analysis(d)
    out = clean(a, "Date Format Problems", ["when_text"], "Convert to Single Format")
    return out.select("o_orderkey", F.col("when_text").cast("string").alias("when_text"))


SQL_CLEAN_DATES = """SELECT o_orderkey, CAST(CASE o_orderkey % 4
    WHEN 0 THEN CAST(strftime(o_orderdate, '%Y-%m-%d') AS TIMESTAMP)
    WHEN 1 THEN strptime(strftime(o_orderdate, '%m/%d/%Y'), '%m/%d/%Y')
    WHEN 2 THEN CAST(strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS TIMESTAMP)
    ELSE NULL END AS VARCHAR) AS when_text FROM orders"""

NUM_MISS = ["price", "price_text"]

QUERIES = {
    "clean_missing_drop_rows": (step("Missing Values", ["priority", "price_text"], "Drop Rows"),
                                TYPED + "\n" + out_sql({}, where_not_any(miss, ["priority", "price_text"]))),
    "clean_missing_custom": (step("Missing Values", ["priority", "price"], "Replace with Custom Value", "0"),
                             custom_sql(["priority", "price"], miss, "0")),
    "clean_missing_mean": (step("Missing Values", NUM_MISS, "Fill with Mean"), fill_stat_sql(NUM_MISS, miss, "mean")),
    "clean_missing_median": (step("Missing Values", NUM_MISS, "Fill with Median"),
                             fill_stat_sql(NUM_MISS, miss, "median")),
    "clean_missing_mode": (step("Missing Values", ["priority", "price"], "Fill with Mode"),
                           fill_stat_sql(["priority", "price"], miss, "mode")),
    "ffill": (step("Missing Values", ["priority", "price"], "Fill using Previous Value"),
              ffill_sql(["priority", "price"], miss, "previous")),
    "bfill": (step("Missing Values", ["priority", "price"], "Fill using Next Value"),
              ffill_sql(["priority", "price"], miss, "next")),
    "interpolate": (step("Missing Values", NUM_MISS, "Linear Interpolation"), interp_sql(NUM_MISS, miss)),
    "clean_empty_remove_rows": (step("Empty Cells", ["priority", "price_text"], "Remove Rows"),
                                TYPED + "\n" + out_sql({}, where_not_any(emp, ["priority", "price_text"]))),
    "clean_empty_null": (step("Empty Cells", ["priority"], "Replace with NULL"),
                         TYPED + "\n" + out_sql({"priority": f"CASE WHEN {emp('priority')} THEN NULL ELSE priority END"})),
    "clean_empty_custom": (step("Empty Cells", ["priority"], "Replace with Custom Value", "EMPTY"),
                           custom_sql(["priority"], emp, "EMPTY")),
    "clean_empty_ffill": (step("Empty Cells", ["priority"], "Fill using Previous Value"),
                          ffill_sql(["priority"], emp, "previous")),
    "clean_outliers_remove": (step("Outliers", ["price"], "Remove Outlier Rows"), outlier_sql("price", "remove")),
    "clean_outliers_cap": (step("Outliers", ["price"], "Cap Values"), outlier_sql("price", "cap")),
    "clean_outliers_winsor": (step("Outliers", ["price"], "Winsorization"), outlier_sql("price", "winsor")),
    "clean_outliers_zclip": (step("Outliers", ["price"], "Z-Score Clipping"), outlier_sql("price", "zclip")),
    "clean_outliers_median": (step("Outliers", ["price"], "Replace using Median"), outlier_sql("price", "median")),
    "clean_outliers_q3": (step("Outliers", ["price"], "Replace with Q3"), outlier_sql("price", "q3")),
    "clean_outliers_p90": (step("Outliers", ["price"], "Replace using Percentile"), outlier_sql("price", "p90")),
    "keep_first": (step("Duplicate Rows", list(DIRTY_KEYS), "Keep First"), keep_sql("first")),
    "keep_last": (step("Duplicate Rows", list(DIRTY_KEYS), "Keep Last"), keep_sql("last")),
    "clean_trim": (step("Extra Spaces", ["all"], "Trim Spaces"),
                   TYPED + "\n" + out_sql({c: S.strip(S.q(c)) for c in TRIM_COLS})),
    "clean_special_chars": (step("Special Characters", ["email", "priority"], "Remove Special Characters"),
                            TYPED + "\n" + out_sql({c: f"regexp_replace({S.q(c)}, '[^\\w\\s\\.\\,\\-\\@\\_]', '', 'g')"
                                                    for c in ("email", "priority")})),
    "clean_std_categories": (step("Inconsistent Categories", ["priority"], "Standardize Format"),
                             TYPED + "\n" + out_sql({"priority": "lower(priority)"})),
    "clean_dates": (q_clean_dates, SQL_CLEAN_DATES),
}


# ------------------------------------------------- more issue x method pairs ---
def out_sql_without(drop, where="true"):
    return out_sql({}, where, cols=[c for c in OUT_COLS if c not in drop])


def q_clean_drop_rows(spark, sf):
    a = Analysis(dirty_orders(spark, sf))
    return shape(clean(a, "Manual Removal", ["all"], "Drop Row", "0, 5, 10, 15, 20", order_by=list(DIRTY_ORDER)))


def q_ignore_missing_flags(spark, sf):
    a = Analysis(dirty_orders(spark, sf), ignored={"Missing Values": ["priority"]})
    f = a.flag_frame()
    return f.select("row_key", "copy_no", F.concat_ws(",", "_missing_cols").alias("_missing_cols"))


SQL_IGNORE = TYPED + "\nSELECT row_key, copy_no, concat_ws(',', " + ", ".join(
    f"CASE WHEN {miss(c)} THEN {S.lit(c)} END" for c in DIRTY_KINDS if c != "priority") + \
    ") AS _missing_cols FROM typed"

QUERIES.update({
    "clean_drop_column": (step("High Null Percentage Columns", ["price_text"], "Drop Column"),
                          TYPED + "\n" + out_sql_without(["price_text"])),
    "clean_drop_rows": (q_clean_drop_rows,
                        TYPED + "\n" + out_sql({}, "rid NOT IN (0, 5, 10, 15, 20)").replace(
                            "SELECT ", "SELECT rid AS _row_id, ", 1)),
    "ignore_missing_flags": (q_ignore_missing_flags, SQL_IGNORE),
    "clean_empty_trim": (step("Empty Cells", ["priority"], "Trim Spaces"),
                         TYPED + "\n" + out_sql({"priority": f"CASE WHEN {emp('priority')} THEN {S.strip('priority')} "
                                                             f"ELSE priority END"})),
    "clean_empty_mode": (step("Empty Cells", ["priority"], "Fill with Mode"), fill_stat_sql(["priority"], emp, "mode")),
    "clean_empty_median": (step("Empty Cells", ["price_text"], "Fill with Median"),
                           fill_stat_sql(["price_text"], emp, "median")),
    "clean_outliers_mean": (step("Outliers", ["price"], "Replace using Mean"), outlier_sql("price", "mean")),
    "clean_outliers_q1": (step("Outliers", ["price"], "Replace with Q1"), outlier_sql("price", "q1")),
    "clean_to_string": (step("Invalid Data Types", ["row_key", "copy_no"], "Convert to String"),
                        TYPED + "\n" + out_sql({"row_key": "CAST(row_key AS VARCHAR)", "copy_no": "CAST(copy_no AS VARCHAR)"})),
    "clean_to_numeric": (step("Invalid Data Types", ["email", "status"], "Convert to Numeric"),
                         TYPED + "\n" + out_sql({"email": "CAST(NULL AS DOUBLE)", "status": "CAST(NULL AS DOUBLE)"})),
    "clean_ignore": (step("Missing Values", ["all"], "Ignore"), TYPED + "\n" + out_sql({})),
})
