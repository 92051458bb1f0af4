"""Registered queries, phase 5: classes, scores, health, diffs, table page."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.analysis import Analysis
from ..operators.classify import auto_classes, column_anomalies, dashboard_classes, quality_classes
from ..operators.clean import clean
from ..operators.diff import changed_rows, removed_rows, step_summary
from ..operators.rowid import ROW_ID, with_row_id
from ..operators.profile import profile
from ..operators.table import even_sample, page, search, sort_by
from . import sqlgen as S
from .clean_queries import TYPED, emp, miss, out_sql, shape
from .quality import column_health, quality_scores, recommendations
from .quality_queries import DIRTY_KINDS, DIRTY_NUMERIC, DIRTY_PROMOTED, dirty_norm_sql, inconsistent_sql, \
    outlier_pred_sql, outlier_rules_sql
from .views import DIRTY_ORDER, dirty_orders, table

DIRTY_DTYPES = {"row_key": "bigint", "priority": "string", "price_text": "double", "price": "double",
                "email": "string", "status": "string", "ordered_at": "timestamp_ntz", "copy_no": "int"}
# The words that make a column an identifier, and the date formats.
ID_WORDS = ("id", "uuid", "code", "key", "token", "number", "serial")
SQL_DATE_FORMATS = "['%Y-%m-%d %H:%M:%S', '%Y-%m-%dT%H:%M:%S', '%Y-%m-%d', '%m/%d/%Y', '%d/%m/%Y', '%Y/%m/%d', " \
                   "'%d-%m-%Y', '%d.%m.%Y', '%b %d, %Y', '%d %b %Y', '%Y%m%d']"


def _typed_value(c):
    if c in DIRTY_PROMOTED:
        return S.numeral("price_text_raw")
    return S.q(c)


def dirty_columns_sql() -> str:
    """SQL ``cols`` CTE body: one row per dirty column with class and counts."""
    rules = outlier_rules_sql("typed", {c: S.q(c) for c in DIRTY_NUMERIC})
    parts = []
    for i, (c, k) in enumerate(DIRTY_KINDS.items()):
        x = S.q(c)
        dt = DIRTY_DTYPES[c]
        name_id = " OR ".join(f"contains(lower({S.lit(c)}), {S.lit(w)})" for w in ID_WORDS)
        if dt == "string":
            share = (f"(SELECT count_if(v IS NOT NULL AND NOT regexp_matches(trim(v), '^[0-9]{{4}}$') AND "
                     f"try_strptime(trim(v), {SQL_DATE_FORMATS}) IS NOT NULL) / nullif(count(v), 0) "
                     f"FROM (SELECT {x} AS v FROM typed))")
        else:
            share = "NULL"
        if c in DIRTY_NUMERIC:
            outl = (f"(SELECT count_if(coalesce({outlier_pred_sql(x, 'r')}, false)) FROM typed "
                    f"LEFT JOIN rules r ON r.col = {S.lit(c)})")
        else:
            outl = "0"
        if c == "email":
            inv = (f"(SELECT count_if({S.nonblank(x)} AND NOT {S.missing(x, 'text')} AND NOT {S.matches(x, 'email')}) "
                   f"FROM typed)")
        elif c in DIRTY_PROMOTED:
            inv = (f"(SELECT count_if({S.valid('price_text_raw', 'text')} AND NOT {S.matches('price_text_raw', 'numeric')}) "
                   f"FROM typed)")
        else:
            inv = "0"
        incons = "(SELECT count(*) > 0 FROM cats)" if c == "priority" else "false"
        parts.append(f"""SELECT {S.lit(c)} AS "column", {i} AS position, {S.lit(dt)} AS dtype,
  count(*) AS rows, count_if({miss(c)}) AS missing, count_if({emp(c)}) AS empty,
  count(DISTINCT {x}) + CAST(count(*) > count({x}) AS BIGINT) AS "distinct", {share} AS date_share,
  ({name_id}) AS name_id, {outl} AS outliers_raw, {inv} AS invalid, {incons} AS inconsistent,
  count_if(NOT {miss(c)} AND NOT {emp(c)}) AS valid, count_if({x} IS NULL) AS nulls FROM typed""")
    union = "\nUNION ALL\n".join(parts)
    dups = ", ".join(f"{dirty_norm_sql(c)}" for c in DIRTY_KINDS)
    return TYPED + f""", rules AS ({rules}),
cats AS ({inconsistent_sql('typed', 'priority')}),
raw_cols AS ({union}),
classed AS (SELECT *, CASE
    WHEN (("distinct" / rows > 0.95) AND dtype IN ('string', 'bigint', 'int')) OR name_id THEN 'Identifier'
    WHEN dtype IN ('date', 'timestamp', 'timestamp_ntz') OR (dtype = 'string' AND coalesce(date_share, 0) > 0.85) THEN 'Date'
    WHEN dtype IN ('tinyint', 'smallint', 'int', 'bigint', 'float', 'double') THEN 'Numeric'
    WHEN dtype = 'string' AND ("distinct" < 100 OR "distinct" / rows < 0.15) THEN 'Categorical'
    WHEN dtype = 'string' THEN 'Text' ELSE 'Unknown' END AS class FROM raw_cols),
cols AS (SELECT *, CASE WHEN class = 'Numeric' THEN outliers_raw ELSE 0 END AS outliers,
    NOT ("column" LIKE '\\_%' ESCAPE '\\') AND (CASE WHEN dtype = 'string' THEN valid > 0 ELSE nulls < rows END) AS active
  FROM classed),
dup AS (SELECT coalesce(sum(n), 0) AS duplicate_rows FROM (SELECT count(*) AS n FROM dirty_orders GROUP BY {dups}) WHERE n > 1)"""


def q_quality_scores(spark, sf):
    return quality_scores(Analysis(dirty_orders(spark, sf)))


SQL_QUALITY_SCORES = dirty_columns_sql() + """,
s AS (SELECT count(*) AS n_cols, max(rows) AS rows, sum(missing) AS missing, sum(empty) AS empty,
        sum(outliers) AS outliers, sum(invalid) AS invalid, count_if(class = 'Numeric') AS n_numeric,
        (SELECT duplicate_rows FROM dup) AS duplicate_rows FROM cols WHERE active),
t AS (SELECT greatest(0, 100 - coalesce((missing + empty) * 100.0 / (rows * n_cols), 0)) AS c,
        greatest(0, 100 - coalesce(duplicate_rows * 100.0 / rows, 0)) AS u,
        coalesce(outliers * 100.0 / (rows * n_numeric), 0) AS op, coalesce(invalid * 100.0 / (rows * n_cols), 0) AS ip,
        coalesce(missing * 100.0 / (rows * n_cols), 0) AS mp, coalesce(empty * 100.0 / (rows * n_cols), 0) AS ep,
        coalesce(duplicate_rows * 100.0 / rows, 0) AS dp, coalesce((missing + empty) * 100.0 / (rows * n_cols), 0) AS mep
      FROM s)
SELECT round(c, 2) AS completeness, round(u, 2) AS consistency, round(greatest(0, 100 - op - ip), 2) AS validity,
  round(u, 2) AS uniqueness, round((c + u + greatest(0, 100 - op - ip) + u) / 4, 2) AS overall,
  round(mp, 2) AS missing_pct, round(ep, 2) AS empty_pct, round(dp, 2) AS duplicate_pct, round(op, 2) AS outlier_pct,
  round(-mep, 2) AS missing_values_impact, round(-dp, 2) AS duplicates_impact, round(-op, 2) AS outliers_impact,
  round(-ip, 2) AS invalid_data_impact FROM t"""


def q_column_health(spark, sf):
    return column_health(Analysis(dirty_orders(spark, sf)))


SQL_COLUMN_HEALTH = dirty_columns_sql() + """,
h AS (SELECT "column", greatest(0, least(100, 100 - missing * 100.0 / rows - 2.0 * outliers * 100.0 / rows
        - 2.0 * invalid * 100.0 / rows - CASE WHEN inconsistent THEN 15 ELSE 0 END)) AS h FROM cols WHERE active)
SELECT "column", round(h, 1) AS health, CASE WHEN h = 100 THEN 'Excellent' WHEN h >= 90 THEN 'Good'
  WHEN h >= 70 THEN 'Needs Attention' ELSE 'Critical' END AS status FROM h"""


def q_recommend_fixes(spark, sf):
    return recommendations(Analysis(dirty_orders(spark, sf)))


SQL_RECOMMEND = dirty_columns_sql() + """,
act AS (SELECT * FROM cols WHERE active),
k AS (SELECT count(*) AS n_cols, max(rows) AS rows, count_if(class = 'Numeric') AS n_num FROM act),
m AS (SELECT 'missing' AS kind, "column", missing AS count, round(missing / (k.rows * k.n_cols) * 100 / 4, 2) AS impact,
        -missing AS sk FROM act, k WHERE missing > 0 ORDER BY missing DESC, position LIMIT 3),
o AS (SELECT 'outliers' AS kind, "column", outliers AS count,
        round(outliers / greatest(1, k.rows * k.n_num) * 100 / 4, 2) AS impact, position AS sk
      FROM act, k WHERE outliers > 0 ORDER BY position LIMIT 2),
b AS (SELECT * FROM m UNION ALL SELECT * FROM o)
SELECT CAST(row_number() OVER (ORDER BY CASE WHEN kind = 'missing' THEN 0 ELSE 1 END, sk) AS INTEGER) AS priority, kind, "column",
  count, impact FROM b WHERE impact > 0.01"""


def q_column_classes(spark, sf):
    a = Analysis(dirty_orders(spark, sf))
    return quality_classes(a.profile_df, a.date_shares).select("column", "class")


SQL_COLUMN_CLASSES = dirty_columns_sql() + "\nSELECT \"column\", class FROM cols"


def q_dashboard_classes(spark, sf):
    o = table(spark, sf, "orders")
    return dashboard_classes(profile(o, with_quantiles=False)).select("column", "class")


def q_auto_classes(spark, sf):
    o = table(spark, sf, "orders")
    c = auto_classes(profile(o, with_quantiles=False))
    return c.select("column", "class", F.round("null_pct", 4).alias("null_pct"), "unique_count",
                    F.round("unique_ratio", 4).alias("unique_ratio"))


ORDERS_TYPES = {"o_orderkey": "bigint", "o_custkey": "bigint", "o_orderstatus": "string", "o_totalprice": "double",
                "o_orderdate": "timestamp_ntz", "o_orderpriority": "string"}


def _orders_stats_sql():
    parts = []
    for c, dt in ORDERS_TYPES.items():
        x = S.q(c)
        mn = f"min(CAST({x} AS DOUBLE))" if dt in ("bigint", "double") else "NULL"
        mx = f"max(CAST({x} AS DOUBLE))" if dt in ("bigint", "double") else "NULL"
        parts.append(f"SELECT {S.lit(c)} AS \"column\", {S.lit(dt)} AS dtype, count(*) AS rows, "
                     f"count_if({x} IS NULL) AS nulls, count(DISTINCT {x}) AS uniq, "
                     f"count(DISTINCT {x}) + CAST(count(*) > count({x}) AS BIGINT) AS \"distinct\", "
                     f"{mn} AS mn, {mx} AS mx FROM orders")
    return "\nUNION ALL\n".join(parts)


SQL_DASHBOARD_CLASSES = f"""WITH p AS ({_orders_stats_sql()})
SELECT "column", CASE
  WHEN dtype IN ('tinyint','smallint','int','bigint','float','double') AND lower("column") LIKE '%id' THEN 'Identifier'
  WHEN dtype IN ('tinyint','smallint','int','bigint','float','double') AND contains(lower("column"), 'year')
       AND mn >= 1900 AND mx <= 2100 THEN 'Date'
  WHEN dtype IN ('tinyint','smallint','int','bigint','float','double') THEN 'Numeric'
  WHEN dtype IN ('date','timestamp','timestamp_ntz') THEN 'Date'
  WHEN dtype = 'string' AND rows - nulls = 0 THEN 'Empty'
  WHEN dtype = 'string' AND (contains(lower("column"), 'city') OR contains(lower("column"), 'country')
       OR contains(lower("column"), 'state') OR contains(lower("column"), 'region') OR contains(lower("column"), 'zip')
       OR contains(lower("column"), 'location') OR contains(lower("column"), 'address')) AND uniq < 1000 THEN 'Geo'
  WHEN dtype = 'string' AND uniq = rows - nulls THEN 'Identifier'
  WHEN dtype = 'string' AND uniq <= 20 THEN 'Categorical_LowCard'
  WHEN dtype = 'string' AND uniq <= 1000 THEN 'Categorical_HighCard'
  WHEN dtype = 'string' THEN 'Text' END AS class FROM p"""

SQL_AUTO_CLASSES = f"""WITH p AS ({_orders_stats_sql()})
SELECT "column", CASE
  WHEN contains(lower("column"), 'id') OR contains(lower("column"), 'uuid') OR contains(lower("column"), 'key')
       OR (dtype IN ('string', 'bigint', 'int') AND "distinct" / rows > 0.95) THEN 'id'
  WHEN dtype IN ('tinyint','smallint','int','bigint','float','double') THEN 'numeric'
  WHEN dtype IN ('date','timestamp','timestamp_ntz') THEN 'date'
  WHEN dtype = 'string' AND ("distinct" < 50 OR "distinct" / rows < 0.05) THEN 'categorical'
  WHEN dtype = 'string' THEN 'text' ELSE 'unknown' END AS class,
  round(nulls / rows, 4) AS null_pct, "distinct" AS unique_count, round("distinct" / rows, 4) AS unique_ratio FROM p"""


def q_col_anomalies(spark, sf):
    a = Analysis(dirty_orders(spark, sf))
    return column_anomalies(a.profile_df)


SQL_COL_ANOMALIES = dirty_columns_sql() + """
SELECT "column", "distinct" = 1 AS constant,
  dtype = 'string' AND rows > 10 AND "distinct" / rows > 0.9 AS high_cardinality,
  round(missing * 100.0 / rows, 2) > 70 AS high_null, round(missing * 100.0 / rows, 2) > 30 AS high_empty,
  CASE WHEN missing * 100.0 / rows < 5 THEN 'Low' WHEN missing * 100.0 / rows <= 20 THEN 'Medium'
       WHEN missing * 100.0 / rows <= 50 THEN 'High' ELSE 'Critical' END AS missing_severity FROM cols"""


# ------------------------------------------------------------- row sets ---
def _blank_count(a: Analysis):
    from ..functions import predicates as P
    exprs = []
    for c in a.columns:
        x, dt = a.text_col(c)
        exprs.append(P.is_blank(x, dt))
    return P.non_null_count(exprs)


def q_poor_quality_rows(spark, sf):
    """Rows with more blank cells (null, whitespace, NaN) than half the active columns."""
    from .quality import poor_quality_rows
    return poor_quality_rows(Analysis(dirty_orders(spark, sf))).select("row_key", "copy_no", "blank_cells")


def q_poor_quality_rows_narrow(spark, sf):
    """B13 on four columns of the dirty view, where rows can be mostly blank."""
    from .quality import poor_quality_rows
    d = dirty_orders(spark, sf).select("row_key", "priority", "price_text", "price")
    return poor_quality_rows(Analysis(d)).select("row_key", "blank_cells")


def _blank_sql(c):
    k = DIRTY_KINDS[c]
    x = "price_text_raw" if c in DIRTY_PROMOTED else S.q(c)
    if k == "text":
        return f"CAST(({x} IS NULL OR {S.strip(x)} = '') AS INTEGER)"
    if k == "float":
        return f"CAST(({x} IS NULL OR isnan({x})) AS INTEGER)"
    return f"CAST({x} IS NULL AS INTEGER)"


SQL_POOR_ROWS = TYPED + "\nSELECT row_key, copy_no, blank_cells FROM (SELECT row_key, copy_no, " + \
    " + ".join(_blank_sql(c) for c in DIRTY_KINDS) + f" AS blank_cells FROM typed) WHERE blank_cells > {len(DIRTY_KINDS) / 2}"


def q_missing_rows(spark, sf):
    """Rows with any missing cell, and the columns having any."""
    a = Analysis(dirty_orders(spark, sf))
    anym = F.lit(False)
    for c in a.columns:
        anym = anym | a.missing_pred(c)
    rows = a.both.agg(F.count_if(anym).alias("missing_rows"))
    cols = a.profile_df.agg(F.count_if(F.col("missing") > 0).alias("columns_affected"))
    return rows.withColumn("columns_affected", cols.scalar())


SQL_MISSING_ROWS = TYPED + "\nSELECT count_if(" + " OR ".join(miss(c) for c in DIRTY_KINDS) + \
    ") AS missing_rows, (SELECT " + " + ".join(f"CAST(count_if({miss(c)}) > 0 AS BIGINT)" for c in DIRTY_KINDS) + \
    " FROM typed) AS columns_affected FROM typed"


def q_missing_heatmap(spark, sf):
    """100 evenly spaced rows (row order row_key, copy_no), 1 per blank cell."""
    a = Analysis(dirty_orders(spark, sf))
    from ..functions import predicates as P
    d = with_row_id(a.both, list(DIRTY_ORDER))
    s = even_sample(d, 100)
    sel = [F.col(ROW_ID)]
    for c in a.columns:
        x, dt = a.text_col(c)
        sel.append(P.is_blank(x, dt).cast("int").alias(c))
    return s.select(*sel)


SQL_HEATMAP = TYPED + "\nSELECT rid AS _row_id, " + ", ".join(f"{_blank_sql(c)} AS {c}" for c in DIRTY_KINDS) + \
    " FROM typed WHERE rid IN (SELECT DISTINCT CAST(floor((SELECT count(*) - 1 FROM typed) * i / 99.0) AS BIGINT) " \
    "FROM range(100) t(i))"


# ---------------------------------------------------------------- diffs ---
def q_diff_removed(spark, sf):
    a = Analysis(dirty_orders(spark, sf))
    after = clean(a, "Missing Values", ["priority"], "Drop Rows")
    return shape(removed_rows(a.typed, after))


SQL_DIFF_REMOVED = TYPED + "\n" + out_sql({}, miss("priority"))


def q_diff_changed(spark, sf):
    d = with_row_id(dirty_orders(spark, sf), list(DIRTY_ORDER))
    a = Analysis(d)
    after = clean(a, "Missing Values", ["price", "priority"], "Fill with Mode")
    ch = changed_rows(a.typed, after)
    return ch.select(ROW_ID, F.concat_ws(",", "changed_columns").alias("changed_columns"))


SQL_DIFF_CHANGED = TYPED + f"""
SELECT rid AS _row_id, concat_ws(',', CASE WHEN {miss('priority')} AND priority IS DISTINCT FROM
  (SELECT v FROM (SELECT priority AS v, count(*) AS n FROM typed WHERE {S.valid('priority', 'text')} GROUP BY 1)
   ORDER BY n DESC, v LIMIT 1) THEN 'priority' END,
  CASE WHEN {miss('price')} THEN 'price' END) AS changed_columns
FROM typed WHERE ({miss('priority')} AND priority IS DISTINCT FROM
  (SELECT v FROM (SELECT priority AS v, count(*) AS n FROM typed WHERE {S.valid('priority', 'text')} GROUP BY 1)
   ORDER BY n DESC, v LIMIT 1)) OR {miss('price')}"""


def q_step_preview(spark, sf):
    a = Analysis(dirty_orders(spark, sf))
    after = clean(a, "Empty Cells", ["priority", "price_text"], "Remove Rows")
    return step_summary(a.typed, after)


SQL_STEP_PREVIEW = TYPED + f"""
SELECT '' AS dropped_columns, count_if({emp('priority')} OR {emp('price_text')}) AS rows_removed,
  CAST(0 AS BIGINT) AS values_changed, count_if(NOT ({emp('priority')} OR {emp('price_text')})) AS rows_remaining
FROM typed"""


# ----------------------------------------------------------- table page ---
def q_table_page_sorted(spark, sf):
    """Rows 101-200 by price descending (nulls first, ties by row id),
    with the row's missing and outlier flags."""
    d = with_row_id(dirty_orders(spark, sf), list(DIRTY_ORDER))
    a = Analysis(d)
    p = a.flag_rows(page(sort_by(a.both, "price", desc=True), 2, 100))
    return p.select(ROW_ID, "row_key", F.round("price", 4).alias("price"),
                    F.concat_ws(",", "_missing_cols").alias("_missing_cols"),
                    F.concat_ws(",", "_outlier_cols").alias("_outlier_cols"))


def _page_sql():
    rules = outlier_rules_sql("typed", {c: S.q(c) for c in DIRTY_NUMERIC})
    miss_l = ", ".join(f"CASE WHEN {miss(c)} THEN {S.lit(c)} END" for c in DIRTY_KINDS)
    outl = ", ".join(f"CASE WHEN coalesce({outlier_pred_sql('t.' + S.q(c), 'r_' + c)}, false) THEN {S.lit(c)} END"
                     for c in DIRTY_NUMERIC)
    joins = " ".join(f"LEFT JOIN rules r_{c} ON r_{c}.col = {S.lit(c)}" for c in DIRTY_NUMERIC)
    return TYPED + f""", rules AS ({rules})
SELECT rid AS _row_id, row_key, round(price, 4) AS price, concat_ws(',', {miss_l}) AS _missing_cols,
  concat_ws(',', {outl}) AS _outlier_cols
FROM typed t {joins} ORDER BY price DESC NULLS FIRST, rid LIMIT 100 OFFSET 100"""


def q_table_search(spark, sf):
    """Literal, case-insensitive search over text columns, first page by row id."""
    d = with_row_id(dirty_orders(spark, sf), list(DIRTY_ORDER))
    s = search(d, "URGENT")
    return page(sort_by(s, None), 1, 100).select(ROW_ID, "row_key", "priority")


SQL_TABLE_SEARCH = TYPED + """
SELECT rid AS _row_id, row_key, priority FROM typed
WHERE contains(lower(priority), 'urgent') OR contains(lower(price_text_raw), 'urgent') OR contains(lower(email), 'urgent')
   OR contains(lower(status), 'urgent')
ORDER BY rid LIMIT 100"""


def q_table_page_stats(spark, sf):
    """J1 stats row for the dirty table, 100 rows a page."""
    from .quality import table_page
    d = with_row_id(dirty_orders(spark, sf), list(DIRTY_ORDER))
    return table_page(Analysis(d), limit=100)[1]


SQL_TABLE_STATS = dirty_columns_sql() + """,
sc AS (""" + SQL_QUALITY_SCORES[SQL_QUALITY_SCORES.index("s AS (SELECT count(*) AS n_cols"):].replace(
    "s AS (SELECT count(*) AS n_cols", "SELECT * FROM (WITH s AS (SELECT count(*) AS n_cols", 1) + """))
SELECT (SELECT max(rows) FROM cols) AS total_rows, CAST(count(*) AS INTEGER) AS total_columns,
  CAST(sum(missing) FILTER (WHERE active) AS BIGINT) AS missing_values,
  CAST(sum(empty) FILTER (WHERE active) AS BIGINT) AS empty_cells,
  CAST((SELECT duplicate_rows FROM dup) AS BIGINT) AS duplicates, CAST(sum(outliers_raw) AS BIGINT) AS outliers,
  (SELECT max(rows) FROM cols) AS filtered_rows,
  CAST(greatest(1, ceil((SELECT max(rows) FROM cols) / 100.0)) AS INTEGER) AS total_pages,
  (SELECT overall FROM sc) AS quality_score
FROM cols"""


def q_table_page_search_stats(spark, sf):
    """J1 stats row of a search: the rows found and their pages."""
    from .quality import table_page
    d = with_row_id(dirty_orders(spark, sf), list(DIRTY_ORDER))
    return table_page(Analysis(d), search_term="URGENT", limit=100)[1].select("total_rows", "filtered_rows", "total_pages")


SQL_TABLE_SEARCH_STATS = TYPED + """
SELECT (SELECT count(*) FROM typed) AS total_rows, count(*) AS filtered_rows,
  CAST(greatest(1, ceil(count(*) / 100.0)) AS INTEGER) AS total_pages FROM typed
WHERE contains(lower(priority), 'urgent') OR contains(lower(price_text_raw), 'urgent') OR contains(lower(email), 'urgent')
   OR contains(lower(status), 'urgent')"""


def q_top_missing(spark, sf):
    """The active columns with the most missing cells."""
    from .quality import column_table, top_missing
    return top_missing(column_table(Analysis(dirty_orders(spark, sf))), 3)


SQL_TOP_MISSING = dirty_columns_sql() + """
SELECT "column", missing, round(missing / rows * 100, 2) AS missing_pct FROM cols WHERE active
ORDER BY missing DESC, position LIMIT 3"""


QUERIES = {
    "table_page_search_stats": (q_table_page_search_stats, SQL_TABLE_SEARCH_STATS),
    "top_missing": (q_top_missing, SQL_TOP_MISSING),
    "quality_scores": (q_quality_scores, SQL_QUALITY_SCORES),
    "table_page_stats": (q_table_page_stats, SQL_TABLE_STATS),
    "column_health": (q_column_health, SQL_COLUMN_HEALTH),
    "recommend_fixes": (q_recommend_fixes, SQL_RECOMMEND),
    "column_classes": (q_column_classes, SQL_COLUMN_CLASSES),
    "dashboard_classes": (q_dashboard_classes, SQL_DASHBOARD_CLASSES),
    "auto_classes": (q_auto_classes, SQL_AUTO_CLASSES),
    "col_anomalies": (q_col_anomalies, SQL_COL_ANOMALIES),
    "poor_quality_rows": (q_poor_quality_rows, SQL_POOR_ROWS),
    "poor_quality_rows_narrow": (q_poor_quality_rows_narrow, TYPED + "\nSELECT row_key, blank_cells FROM (SELECT row_key, "
                                 + " + ".join(_blank_sql(c) for c in ("row_key", "priority", "price_text", "price"))
                                 + " AS blank_cells FROM typed) WHERE blank_cells > 2"),
    "missing_rows": (q_missing_rows, SQL_MISSING_ROWS),
    "missing_heatmap": (q_missing_heatmap, SQL_HEATMAP),
    "diff_removed": (q_diff_removed, SQL_DIFF_REMOVED),
    "diff_changed": (q_diff_changed, SQL_DIFF_CHANGED),
    "step_preview": (q_step_preview, SQL_STEP_PREVIEW),
    "table_page_sorted": (q_table_page_sorted, _page_sql()),
    "table_search": (q_table_search, SQL_TABLE_SEARCH),
}
