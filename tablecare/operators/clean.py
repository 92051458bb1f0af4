"""Cleaning operators (I1-I27): ``clean(analysis, issue, columns, method)``.

Each step is a pure ``DataFrame -> DataFrame`` projection or filter over the
typed frame; statistics (mean, median, mode, bounds, percentiles) come from
the analysis' profile as literals, so the step stays one fused projection and
filters reach the scan.  Unknown issue/method pairs raise ``ValueError``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import predicates as P
from .analysis import Analysis, outlier_rule
from .duplicates import keep
from .fill import DEFAULT_BLOCK, fill
from .rowid import ROW_ID, ensure_row_id

# --- fixed values: method names and their aliases --------------------------
KEEP_FIRST = ("Remove Exact Duplicates", "Keep First Occurrence", "Keep First", "Merge Records",
              "Merge Duplicate Records", "Keep Most Complete Row")
KEEP_LAST = ("Keep Latest Occurrence", "Keep Last")
DUP_ISSUES = ("Duplicate Rows", "Exact Duplicates", "Business Duplicates", "Near Duplicates")
DROP_ISSUES = ("Constant Columns", "High Cardinality", "Duplicate Columns", "High Null Percentage Columns")
DROP_METHODS = ("Drop Column", "Drop Duplicate Columns", "Drop Columns")
PREVIOUS = ("Fill using Previous Value", "Replace with Previous Value")
KEEP_AS_IS = ("Keep As Is", "Keep Outliers", "Manual Review")   # advisory choices: the table is unchanged
NEXT = ("Fill using Next Value", "Replace with Next Value")
# --- end of fixed values ----------------------------------------------------

# Formats tried, in order, when unifying date texts (Spark datetime patterns).
DATE_FORMATS = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd", "MM/dd/yyyy", "dd/MM/yyyy",
                "yyyy/MM/dd", "dd-MM-yyyy", "dd.MM.yyyy", "MMM d, yyyy", "d MMM yyyy", "yyyyMMdd")
NUMBER_TEXT = r"(?U)^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\z"


def _targets(a: Analysis, columns) -> list[str]:
    if not columns or columns == "all" or (isinstance(columns, (list, tuple)) and columns and columns[0] == "all"):
        return list(a.columns)
    return [c for c in columns if c in a.columns]


def _numeric(a: Analysis, c: str) -> bool:
    return P.is_numeric(a.types[c])


def _replace(a: Analysis, exprs: dict[str, Column], base: DataFrame | None = None) -> DataFrame:
    base = base if base is not None else a.both
    return base.select(*[exprs[c].alias(c) if c in exprs else F.col(P.quoted(c)) for c in a.out_cols])


def _custom(a: Analysis, c: str, value) -> Column:
    if _numeric(a, c):
        try:
            v = float(value)
        except (TypeError, ValueError):
            v = None
        return F.lit(v).cast("double")
    return F.lit(value or "Unknown")


def _stat_lit(a: Analysis, c: str, stat: str) -> Column | None:
    st = a.stats[c]
    if stat == "mode":
        if _numeric(a, c):
            v = st.get("mode_num")
            return None if v is None else F.lit(v)
        v = st.get("mode")
        return None if v is None else F.lit(v)
    if not _numeric(a, c):
        return None
    v = st.get(stat)
    return None if v is None else F.lit(v)


def _fill_cells(a: Analysis, cols, method: str, custom_value, target_of, block: int, order_by) -> DataFrame:
    """Shared by missing and empty cells: replace target cells per method."""
    if method == "Replace with Custom Value":
        return _replace(a, {c: F.when(target_of(c), _custom(a, c, custom_value)).otherwise(F.col(P.quoted(c))) for c in cols})
    for stat in ("Mean", "Median", "Mode"):
        if method in (f"Fill with {stat}", f"Replace with {stat}"):
            exprs = {}
            for c in cols:
                v = _stat_lit(a, c, stat.lower())
                if v is not None:
                    exprs[c] = F.when(target_of(c), v).otherwise(F.col(P.quoted(c)))
            return _replace(a, exprs)
    if method in PREVIOUS + NEXT + ("Linear Interpolation",):
        kind = "previous" if method in PREVIOUS else "next" if method in NEXT else "linear"
        if kind == "linear":
            cols = [c for c in cols if _numeric(a, c)]
        base = ensure_row_id(a.both, order_by)
        usable = {c: ~a.missing_pred(c) & ~a.empty_pred(c) & F.col(P.quoted(c)).isNotNull() for c in cols}
        targets = {c: target_of(c) for c in cols}
        out = fill(base, targets, usable, kind, ROW_ID, block)
        return out.select(*a.out)
    raise ValueError(f"unknown method {method!r}")


OUTLIER_METHODS = ("Remove Outliers", "Remove Outlier Rows", "Cap to Upper Bound", "Cap Values", "IQR Clipping",
                   "Winsorization", "Z-Score Clipping", "Replace using Median", "Replace using Mean",
                   "Replace with Q1", "Replace with Q3", "Replace using Percentile")


def _outliers(a: Analysis, cols, method: str) -> DataFrame:
    if method not in OUTLIER_METHODS:
        raise ValueError(f"unknown method {method!r}")
    exprs, keep_rows = {}, F.lit(True)
    for c in cols:
        if not _numeric(a, c):
            continue
        st = a.stats[c]
        rule = a.outlier_rules.get(c) or outlier_rule(st)
        if not rule.get("method") or rule["method"] == "None":
            if (st.get("n") or 0) < 10 or st.get("q1") is None:
                continue
            iqr = st["q3"] - st["q1"]
            rule = {"method": "IQR", "lower": st["q1"] - 1.5 * iqr, "upper": st["q3"] + 1.5 * iqr}
        lo, hi = F.lit(rule["lower"]), F.lit(rule["upper"])
        x = F.col(P.quoted(c))
        out = (x < lo) | (x > hi)
        if method in ("Remove Outliers", "Remove Outlier Rows"):
            keep_rows = keep_rows & (~out | x.isNull())
        elif method in ("Cap to Upper Bound", "Cap Values", "IQR Clipping"):
            exprs[c] = F.when(x > hi, hi).when(x < lo, lo).otherwise(x)
        elif method == "Winsorization":
            p5, p95 = F.lit(st["p5"]), F.lit(st["p95"])
            exprs[c] = F.when(x > p95, p95).when(x < p5, p5).otherwise(x)
        elif method == "Z-Score Clipping":
            std, mean = st.get("std"), st.get("mean")
            if std and std > 0:
                zl, zh = F.lit(mean - 3 * std), F.lit(mean + 3 * std)
                exprs[c] = F.when(x > zh, zh).when(x < zl, zl).otherwise(x)
        else:
            stat = {"Replace using Median": "median", "Replace using Mean": "mean", "Replace with Q1": "q1",
                    "Replace with Q3": "q3", "Replace using Percentile": "p90"}.get(method)
            if stat is None:
                raise ValueError(f"unknown method {method!r}")
            exprs[c] = F.when(out, F.lit(st[stat])).otherwise(x)
    return _replace(a, exprs, a.both.where(keep_rows))


def clean(a: Analysis, issue: str, columns=("all",), method: str = "Ignore", custom_value=None,
          order_by=None, block: int = DEFAULT_BLOCK) -> DataFrame:
    """One named cleaning step over the analysed table; returns the typed frame."""
    cols = _targets(a, columns)
    if method in ("Ignore",) + KEEP_AS_IS:
        return a.typed
    if issue == "Missing Values":
        if method in ("Drop Rows", "Delete Rows containing Missing Values"):
            anym = F.lit(False)
            for c in cols:
                anym = anym | a.missing_pred(c)
            return a.both.where(~anym).select(*a.out)
        if method in ("Drop Column", "Delete Columns containing Missing Values"):
            return a.typed.drop(*cols)
        return _fill_cells(a, cols, method, custom_value, a.missing_pred, block, order_by)
    if issue == "Empty Cells":
        if method in ("Remove Rows", "Remove Rows containing Empty Cells"):
            anye = F.lit(False)
            for c in cols:
                anye = anye | a.empty_pred(c)
            return a.both.where(~anye).select(*a.out)
        if method in ("Remove Columns", "Remove Columns containing Empty Cells"):
            return a.typed.drop(*cols)
        if method == "Trim Spaces":
            return _replace(a, {c: F.when(a.empty_pred(c), P.strip_ws(c)).otherwise(F.col(P.quoted(c)))
                                for c in cols if P.is_string(a.types[c])})
        if method == "Replace with NULL":
            return _replace(a, {c: F.when(a.empty_pred(c), F.lit(None)).otherwise(F.col(P.quoted(c))) for c in cols})
        return _fill_cells(a, cols, method, custom_value, a.empty_pred, block, order_by)
    if issue == "Outliers":
        return _outliers(a, cols, method)
    if issue in DUP_ISSUES:
        whole = len(cols) == len(a.columns)
        which = "first" if method in KEEP_FIRST else "last" if method in KEEP_LAST else None
        if which is None:
            raise ValueError(f"unknown method {method!r}")
        return keep(a.typed, None if whole else cols, which, order_by, normalise=whole)
    if issue == "Extra Spaces" and method == "Trim Spaces":
        return _replace(a, {c: P.strip_ws(F.col(P.quoted(c))) for c in cols if P.is_string(a.types[c])}, a.typed)
    if issue == "Special Characters" and method == "Remove Special Characters":
        return _replace(a, {c: F.regexp_replace(F.col(P.quoted(c)), P.SPECIAL_CHARS_PATTERN, "") for c in cols
                            if P.is_string(a.types[c])}, a.typed)
    if issue in DROP_ISSUES:
        if method in DROP_METHODS:
            return a.typed.drop(*cols)
        raise ValueError(f"unknown method {method!r}")
    if issue == "Invalid Data Types":
        if method == "Convert to Numeric":
            return _replace(a, {c: (F.when(F.col(P.quoted(c)).cast("string").rlike(NUMBER_TEXT), F.col(P.quoted(c)).cast("double"))
                                    if not _numeric(a, c) else F.col(P.quoted(c)).cast("double")) for c in cols}, a.typed)
        if method == "Convert to String":
            return _replace(a, {c: F.col(P.quoted(c)).cast("string") for c in cols}, a.typed)
        raise ValueError(f"unknown method {method!r}")
    if issue == "Inconsistent Categories" and method == "Standardize Format":
        return _replace(a, {c: F.lower(F.col(P.quoted(c))) for c in cols if P.is_string(a.types[c])}, a.typed)
    if issue == "Date Format Problems" and method == "Convert to Single Format":
        return _replace(a, {c: unify_dates(F.col(P.quoted(c))) for c in cols}, a.typed)
    if issue == "Manual Removal":
        if method == "Drop Column":
            return a.typed.drop(*cols)
        if method == "Drop Row":
            ids = [int(x.strip()) for x in str(custom_value or "").split(",") if x.strip()]
            d = ensure_row_id(a.typed, order_by)
            return drop_rows(d, ids)
    raise ValueError(f"unknown issue/method: {issue!r} / {method!r}")


def unify_dates(x: Column, formats=DATE_FORMATS) -> Column:
    """Text in any of ``formats`` to a timestamp; anything else null."""
    s = P.strip_ws(x.cast("string"))
    return F.coalesce(*[F.try_to_timestamp(s, F.lit(f)) for f in formats])


def drop_rows(df: DataFrame, ids, id_col: str = ROW_ID) -> DataFrame:
    """Remove rows by id: an anti join with the ids (a list or a DataFrame)."""
    if isinstance(ids, DataFrame):
        return df.join(ids.select(F.col(ids.columns[0]).alias(id_col)), id_col, "left_anti")
    ids = list(ids)
    if not ids:
        return df
    spark = df.sparkSession
    return df.join(spark.createDataFrame([(int(i),) for i in ids], f"{id_col} bigint"), id_col, "left_anti")


def drop_columns(df: DataFrame, cols) -> DataFrame:
    return df.drop(*cols)
