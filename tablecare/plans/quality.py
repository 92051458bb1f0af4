"""Quality report (J2-J5): scores, column health, anomalies, recommendations.

Everything is derived from three small DataFrames of the analysis -- the
profile, the per-column issue counts and the duplicate total -- by joins and
projections on one-row-per-column tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..operators.analysis import Analysis
from ..operators.classify import active_flag, column_anomalies, quality_classes


def column_table(a: Analysis) -> DataFrame:
    """Per column: class, activity and every count the scores use."""
    prof = quality_classes(a.profile_df, a.date_shares)
    counts = a.issue_counts()
    # issue counts honour ignored issues, so they replace the profile's counts
    t = prof.drop("missing", "empty").join(counts, "column").withColumn("active", active_flag(prof))
    numeric = (F.col("class") == "Numeric")
    return t.select("column", "position", "dtype", "class", "active", "rows", "missing", "empty", "distinct",
                    "dup_cells", F.when(numeric, F.col("outliers")).otherwise(F.lit(0)).alias("outliers"),
                    F.when(~F.col("column").startswith("_"), F.col("invalid")).otherwise(F.lit(0)).alias("invalid"),
                    (F.col("inconsistent") > 0).alias("inconsistent"))


def quality_scores(a: Analysis, cols: DataFrame | None = None) -> DataFrame:
    """One row of scores (rounded to 2) and deductions."""
    cols = cols if cols is not None else column_table(a)
    act = cols.where("active")
    dups = a.duplicate_rows_total().select("duplicate_rows")
    s = act.agg(F.count(F.lit(1)).alias("n_cols"), F.max("rows").alias("rows"),
                F.sum("missing").alias("missing"), F.sum("empty").alias("empty"),
                F.sum("outliers").alias("outliers"), F.sum("invalid").alias("invalid"),
                F.count_if(F.col("class") == "Numeric").alias("n_numeric"))
    s = s.withColumn("duplicate_rows", F.lit(dups.first()["duplicate_rows"]))
    rows, cells = F.col("rows"), F.col("rows") * F.col("n_cols")
    miss_emp = F.try_divide((F.col("missing") + F.col("empty")) * 100.0, cells)
    dup_pct = F.try_divide(F.col("duplicate_rows") * 100.0, rows)
    out_pct = F.coalesce(F.try_divide(F.col("outliers") * 100.0, rows * F.col("n_numeric")), F.lit(0.0))
    mis_pct = F.coalesce(F.try_divide(F.col("invalid") * 100.0, cells), F.lit(0.0))
    completeness = F.greatest(F.lit(0.0), F.lit(100.0) - F.coalesce(miss_emp, F.lit(0.0)))
    consistency = F.greatest(F.lit(0.0), F.lit(100.0) - F.coalesce(dup_pct, F.lit(0.0)))
    validity = F.greatest(F.lit(0.0), F.lit(100.0) - out_pct - mis_pct)
    t = s.select(completeness.alias("c"), consistency.alias("u"), validity.alias("v"),
                 F.coalesce(F.try_divide(F.col("missing") * 100.0, cells), F.lit(0.0)).alias("mp"),
                 F.coalesce(F.try_divide(F.col("empty") * 100.0, cells), F.lit(0.0)).alias("ep"),
                 F.coalesce(dup_pct, F.lit(0.0)).alias("dp"), out_pct.alias("op"), mis_pct.alias("ip"),
                 F.coalesce(miss_emp, F.lit(0.0)).alias("mep"))
    r = lambda c, n: F.round(c, 2).alias(n)
    overall = (F.col("c") + F.col("u") + F.col("v") + F.col("u")) / 4
    return t.select(r(F.col("c"), "completeness"), r(F.col("u"), "consistency"), r(F.col("v"), "validity"),
                    r(F.col("u"), "uniqueness"), r(overall, "overall"), r(F.col("mp"), "missing_pct"),
                    r(F.col("ep"), "empty_pct"), r(F.col("dp"), "duplicate_pct"), r(F.col("op"), "outlier_pct"),
                    r(-F.col("mep"), "missing_values_impact"), r(-F.col("dp"), "duplicates_impact"),
                    r(-F.col("op"), "outliers_impact"), r(-F.col("ip"), "invalid_data_impact"))


def column_health(a: Analysis, cols: DataFrame | None = None) -> DataFrame:
    """Per active column, ``health`` in 0..100 (rounded 1) and its status."""
    cols = cols if cols is not None else column_table(a)
    act = cols.where("active")
    pct = lambda c: F.col(c) / F.col("rows") * 100
    h = (F.lit(100.0) - pct("missing") - 2.0 * pct("outliers") - 2.0 * pct("invalid")
         - F.when(F.col("inconsistent"), F.lit(15.0)).otherwise(F.lit(0.0)))
    h = F.greatest(F.lit(0.0), F.least(F.lit(100.0), h))
    status = (F.when(h == 100.0, "Excellent").when(h >= 90.0, "Good").when(h >= 70.0, "Needs Attention")
               .otherwise("Critical"))
    return act.select("column", F.round(h, 1).alias("health"), status.alias("status"))


def recommendations(a: Analysis, cols: DataFrame | None = None) -> DataFrame:
    """Top-3 missing columns and the first two outlier columns, with the
    expected score gain (share/4), kept above 0.01."""
    cols = cols if cols is not None else column_table(a)
    act = cols.where("active")
    n_cols = act.count()
    n_num = act.where(F.col("class") == "Numeric").count()
    rows = a.rows
    cells = rows * n_cols
    miss = (act.where(F.col("missing") > 0).orderBy(F.desc("missing"), "position").limit(3)
               .select(F.lit("missing").alias("kind"), "column", F.col("missing").alias("count"),
                       F.round(F.col("missing") / F.lit(cells) * 100 / 4, 2).alias("impact"), "position"))
    outl = (act.where(F.col("outliers") > 0).orderBy("position").limit(2)
               .select(F.lit("outliers").alias("kind"), "column", F.col("outliers").alias("count"),
                       F.round(F.col("outliers") / F.lit(max(1, rows * n_num)) * 100 / 4, 2).alias("impact"),
                       "position"))
    both = miss.unionByName(outl).where(F.col("impact") > 0.01)
    # missing columns by count desc, then outlier columns in column order
    w = Window.orderBy(F.when(F.col("kind") == "missing", 0).otherwise(1),
                       F.when(F.col("kind") == "missing", -F.col("count")).otherwise(F.col("position")))
    return both.select(F.row_number().over(w).alias("priority"), "kind", "column", "count", "impact")


def poor_quality_rows(a: Analysis, cols: DataFrame | None = None) -> DataFrame:
    """Rows where blank cells (null, whitespace-only, NaN; sentinels do
    not count) outnumber half of the active columns, with their blank count."""
    from ..functions import predicates as P
    cols = cols if cols is not None else column_table(a)
    active = [r["column"] for r in cols.where("active").select("column").collect()]   # one name per column
    blanks = P.non_null_count([P.is_blank(*a.text_col(c)) for c in active])
    return (a.both.withColumn("blank_cells", blanks).where(F.col("blank_cells") > len(active) / 2)
             .select(*a.out, "blank_cells"))


def top_missing(cols: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` active columns with the most missing cells."""
    return (cols.where("active").orderBy(F.desc("missing"), "position").limit(k)
                .select("column", "missing", F.round(F.col("missing") / F.col("rows") * 100, 2).alias("missing_pct")))


def duplicate_value_columns(cols: DataFrame, k: int = 10) -> DataFrame:
    """Active columns whose values repeat, most repeated cells first."""
    return (cols.where(F.col("active") & (F.col("dup_cells") > 0)).orderBy(F.desc("dup_cells"), "position").limit(k)
                .select("column", "dup_cells", F.round(F.col("dup_cells") / F.col("rows") * 100, 2).alias("dup_pct")))


def class_counts(cols: DataFrame) -> DataFrame:
    """Dataset summary: number of active columns per class."""
    return cols.where("active").groupBy("class").agg(F.count(F.lit(1)).alias("columns"))


def quality_report(a: Analysis) -> dict[str, DataFrame]:
    """The report as named small DataFrames."""
    from ..operators.analysis import outlier_extremes
    if a.rows == 0:
        return {"error": a.raw.sparkSession.createDataFrame([("Dataset is empty.",)], "error string")}
    cols = column_table(a)
    numeric = [r["column"] for r in cols.where(F.col("active") & (F.col("class") == "Numeric")).collect()]
    return {
        "top_missing": top_missing(cols),
        "duplicate_values": duplicate_value_columns(cols),
        "class_counts": class_counts(cols),
        "outlier_summary": outlier_extremes(a, numeric),
        "poor_quality_rows": poor_quality_rows(a, cols),
        "columns": cols,
        "scores": quality_scores(a, cols),
        "health": column_health(a, cols),
        "anomalies": column_anomalies(a.profile_df),
        "outliers": a.outlier_table(),
        "invalid": a.issue_counts().select("column", "invalid").where(F.col("invalid") > 0),
        "categories": a.category_table,
        "recommendations": recommendations(a, cols),
    }


def table_page(a: Analysis, search_term: str = "", sort: str | None = None, desc: bool = False,
               page_no: int = 1, limit: int = 100, order_by=None, pages=None):
    """One page of the flagged table and its stats row.

    Rows get a row id (``order_by`` or the frame's order), are searched
    (literal, text columns), sorted (nulls first, ties by row id) and sliced;
    only the page's rows are then flagged.  ``pages``, a ``SortedPages`` of the
    rows (``sorted_pages``), makes a deep page as cheap as the first.  Stats: total rows/columns, rows
    found by the search, missing and empty cells (active columns), duplicate rows, outlier cells (every numeric
    column with a rule), total pages and the overall score."""
    from ..operators.rowid import ROW_ID, with_row_id
    from ..operators.table import page, search, sort_by, total_pages
    numbered = a.both if ROW_ID in a.both.columns else with_row_id(a.both, order_by)
    found = search(numbered, search_term, columns=a.columns)
    rows = a.flag_rows(pages.page(page_no, limit) if pages else page(sort_by(found, sort, desc), page_no, limit))
    rows = sort_by(rows, sort, desc)
    cols = column_table(a)
    act = cols.where("active")
    n_found = found.count() if search_term else a.rows
    outliers = sum(r["outliers"] for r in a.issue_counts().collect())
    stats = (act.agg(F.sum("missing").alias("missing_values"), F.sum("empty").alias("empty_cells"))
                .select(F.lit(a.rows).cast("bigint").alias("total_rows"),
                        F.lit(len(a.columns)).alias("total_columns"), "missing_values", "empty_cells",
                        F.lit(a.duplicate_rows_total().first()["duplicate_rows"]).cast("bigint").alias("duplicates"),
                        F.lit(outliers).cast("bigint").alias("outliers"),
                        F.lit(n_found).cast("bigint").alias("filtered_rows"),
                        F.lit(total_pages(n_found, limit)).alias("total_pages"),
                        F.lit(quality_scores(a, cols).first()["overall"]).alias("quality_score")))
    return rows, stats


def sorted_pages(a: Analysis, search_term: str = "", sort: str | None = None, desc: bool = False, order_by=None,
                 rows_per_range: int = 1 << 20):
    """The rows that ``table_page`` pages through, sorted once for any number of pages."""
    from ..operators.paging import SortedPages
    from ..operators.rowid import ROW_ID, with_row_id
    from ..operators.table import search
    numbered = a.both if ROW_ID in a.both.columns else with_row_id(a.both, order_by)
    return SortedPages(search(numbered, search_term, columns=a.columns), sort, desc, [ROW_ID], rows_per_range)


def preview(a: Analysis, issue: str, columns=("all",), method: str = "Ignore", custom_value=None,
            order_by=None, samples: int = 5) -> dict:
    """What a cleaning step would do, without applying it.

    ``metrics``: dropped columns, rows removed, cells changed, rows remaining,
    current and estimated score and the improvement (never negative);
    ``before`` / ``after``: up to ``samples`` affected rows (removed rows for
    row-dropping steps, changed rows otherwise, first rows when columns are
    dropped)."""
    from ..operators.clean import clean
    from ..operators.diff import changed_rows, removed_counts, step_summary
    from ..operators.rowid import ROW_ID, with_row_id
    from ..session import pinned
    base = a if ROW_ID in a.raw.columns else Analysis(with_row_id(a.raw, order_by), a.tokens, a.threshold, a.share, a.ignored)
    after = clean(base, issue, list(columns), method, custom_value, order_by=order_by)
    found = []  # ids of the changed rows and their changed columns, found once

    def changed(*args):
        found.append(pinned(changed_rows(*args)))
        return found[0]

    summary = step_summary(base.typed, after, changed=changed).first()
    unchanged: set = set()  # columns that hold the same cells after the step
    if found:
        unchanged = set(base.columns) - {r[0] for r in found[0].select(F.explode("changed_columns")).distinct().collect()}
    elif summary["dropped_columns"] and not summary["rows_removed"]:  # such a step leaves the other columns as they are
        unchanged = set(base.columns)
    before_score = quality_scores(base).first()["overall"]
    after_score = quality_scores(Analysis(after, base.tokens, base.threshold, base.share, base.ignored,
                                          known=(base, unchanged))).first()["overall"]
    if summary["dropped_columns"]:
        b, c = base.typed.orderBy(ROW_ID).limit(samples), after.orderBy(ROW_ID).limit(samples)
    elif summary["rows_removed"]:
        b = removed_counts(base.typed.drop(ROW_ID), after.drop(ROW_ID)).limit(samples)
        c = b.limit(0)
    else:
        ids = F.broadcast(found[0].select(ROW_ID).orderBy(ROW_ID).limit(samples))
        b = base.typed.join(ids, ROW_ID, "left_semi").orderBy(ROW_ID)
        c = after.join(ids, ROW_ID, "left_semi").orderBy(ROW_ID)
    metrics = a.raw.sparkSession.createDataFrame([(
        summary["dropped_columns"], summary["rows_removed"], summary["values_changed"], summary["rows_remaining"],
        before_score, after_score, round(max(0.0, after_score - before_score), 2))],
        "dropped_columns string, rows_removed bigint, values_changed bigint, rows_remaining bigint, "
        "current_score double, estimated_score double, improvement double")
    return {"metrics": metrics, "before": b, "after": c}
