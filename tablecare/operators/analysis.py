"""Typed, profiled and flagged view of one table.

``Analysis(raw)`` runs the small decision jobs once (type evidence, profile,
category spellings) and keeps their results on the driver -- one entry per
column, never per row.  Row-level outputs (flags, outlier rows, duplicate
groups) stay lazy DataFrames built from those literals, so Catalyst can push
them into scans and fuse them into one projection.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..functions import predicates as P
from ..session import pinned
from .classify import date_counts
from .infer import TypePlan, invalid_predicate, numeral_to_double
from .rowid import ROW_ID
from .profile import (MOMENT_KEYS, QUANTILES, approx_stats, distinct_stats, first_pass, modes, profile, quantile_stats,
                      spelling_counts, value_counts_long)

FLAG_COLUMNS = ("_is_duplicate", "_outlier_cols", "_empty_cols", "_missing_cols",
                "_invalid_type_cols", "_inconsistent_category_cols")
DUPLICATE_ISSUES = ("Duplicate Rows", "Exact Duplicates")


def outlier_rule(st: dict, min_n: int = 10, z_min_n: int = 50000, max_skew: float = 0.5) -> dict:
    """Method and bounds for one numeric column's profile row."""
    n = st.get("n") or 0
    if n < min_n:
        return {"method": None, "lower": None, "upper": None}
    skew = st.get("skew")
    if n > z_min_n and skew is not None and abs(skew) < max_skew:
        std, mean = st.get("std"), st.get("mean")
        if std is not None and std > 0:
            return {"method": "Z-Score", "lower": mean - 3 * std, "upper": mean + 3 * std, "mean": mean, "std": std}
        return {"method": "None", "lower": None, "upper": None}
    q1, q3 = st.get("q1"), st.get("q3")  # only here are the quartiles needed
    if q1 is None:
        return {"method": None, "lower": None, "upper": None}
    iqr = q3 - q1
    return {"method": "IQR", "lower": q1 - 1.5 * iqr, "upper": q3 + 1.5 * iqr}


def outlier_predicate(c, rule: dict) -> Column:
    x = P.col_of(c)
    if rule["method"] == "IQR":
        return (x < F.lit(rule["lower"])) | (x > F.lit(rule["upper"]))
    if rule["method"] == "Z-Score":
        return F.abs((x - F.lit(rule["mean"])) / F.lit(rule["std"])) > F.lit(3.0)
    return F.lit(False)


def normalised(c: str, dtype, tokens=P.MISSING_TOKENS) -> Column:
    """Duplicate key of a cell: stripped text with sentinels as null, integers
    and decimals as they are (exact), floats as double with one zero."""
    x = F.col(P.quoted(c))
    if P.is_string(dtype):
        s = P.strip_ws(x)
        return F.when(~F.lower(s).isin(*tokens), s)
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return x.cast("double") + F.lit(0.0)
    return x


class ColumnStats:
    """One column's statistics; a pass over the table runs when the first of
    its results is asked for, and serves all columns."""

    def __init__(self, analysis: Analysis, column: str):
        self.analysis, self.column = analysis, column

    def get(self, key: str):
        a, c = self.analysis, self.column
        if key in a._moments[c]:
            return a._moments[c][key]
        if key in QUANTILES:
            return a._quantiles.get(c, {}).get(key) if P.is_numeric(a.types[c]) else None
        return a._distinct.get(c, key)

    def __getitem__(self, key: str):
        return self.get(key)


class DistinctStats:
    """Distinct counts and modes.  A mode is found without a count of the
    distinct values; the counts of all columns come in one pass, when the first
    of them is asked for."""

    def __init__(self, analysis: Analysis):
        self.analysis = analysis
        self.modes: dict[str, dict] = {}

    @cached_property
    def rows(self) -> dict[str, dict]:
        a = self.analysis
        part = approx_stats if a.approx else distinct_stats
        rows = {c: a.known[0]._distinct.rows[c] for c in a._known_columns}
        columns = [c for c in a.columns if c not in rows]
        return rows | ({r["column"]: r.asDict() for r in part(a.both, columns, a.tokens).collect()} if columns or not rows else {})

    @property
    def counted(self) -> bool:
        return "rows" in self.__dict__

    def mode_of(self, c: str) -> dict:
        if c not in self.modes:
            a = self.analysis
            text, number, _ = modes(a.both, [c], a.tokens)[c]
            as_text = None if number is None else a.raw.sparkSession.range(1).select(F.lit(number).cast("string")).first()[0]
            self.modes[c] = {"mode": as_text if number is not None else text, "mode_num": number}
        return self.modes[c]

    def get(self, column: str, key: str):
        if key in ("mode", "mode_num") and not self.counted and not self.analysis.approx:
            return self.mode_of(column)[key]
        return self.rows.get(column, {}).get(key)


class Analysis:
    def __init__(self, raw: DataFrame, tokens=P.MISSING_TOKENS, threshold: float = 0.9, share: float = 0.8,
                 ignored: dict | None = None, dup_keys: list[str] | None = None,
                 approx: bool = False, known: tuple[Analysis, set] | None = None):
        """``known`` -- an analysis of another table and the columns that hold the same cells in both: their distinct
        counts, modes and quantiles are taken from it."""
        self.raw = raw
        self.known = known
        self.approx = approx
        self.tokens = tokens
        self.threshold, self.share = threshold, share
        self.ignored = ignored or {}
        # the row id (if any) is carried through, never analysed or used as a key
        self.out_cols = list(raw.columns)
        self.carried = [c for c in raw.columns if c == ROW_ID]
        self.columns = [c for c in raw.columns if c != ROW_ID]
        self.dup_keys = list(dup_keys) if dup_keys else list(self.columns)
        self.raw_types = {f.name: f.dataType for f in raw.schema.fields}

    # ---- decisions (small jobs, results on the driver) -------------------
    @cached_property
    def _first(self) -> dict:
        """One aggregate over the table as read: type evidence + moments."""
        return first_pass(self.raw, self.columns, self.tokens)

    @cached_property
    def plan(self) -> TypePlan:
        texts = {c for c in self.columns if P.is_string(self.raw_types[c])}
        return TypePlan.from_counts(self._first, self.columns, texts, self.threshold, self.share)

    def _text_name(self, c: str) -> str:
        return f"__text_{self.columns.index(c)}"

    @cached_property
    def both(self) -> DataFrame:
        """Typed columns plus the original text of promoted columns."""
        typed = [numeral_to_double(c).alias(c) if c in self.plan.promoted else F.col(P.quoted(c)) for c in self.out_cols]
        texts = [F.col(P.quoted(c)).alias(self._text_name(c)) for c in self.plan.promoted]
        return self.raw.select(*typed, *texts)

    @property
    def out(self) -> list[Column]:
        """The table's columns, whatever their names."""
        return [F.col(P.quoted(c)) for c in self.out_cols]

    @cached_property
    def typed(self) -> DataFrame:
        return self.both.select(*self.out)

    @cached_property
    def types(self) -> dict:
        return {f.name: f.dataType for f in self.typed.schema.fields}

    def _moment_row(self, i: int, c: str) -> dict:
        f = self._first
        dt = self.types[c]
        promoted = c in self.plan.promoted
        key = f"{i}_x" if promoted else f"{i}"
        row = {"column": c, "position": i, "dtype": dt.simpleString(), "rows": f["rows"],
               "nulls": f[f"{i}_xnulls"] if promoted else f[f"{i}_nulls"],
               "missing": f[f"{i}_missing"], "empty": f[f"{i}_empty"],
               "valid": f["rows"] - f[f"{i}_missing"] - f[f"{i}_empty"]}
        for k in MOMENT_KEYS:
            row[k] = f.get(f"{key}_{k}") if P.is_numeric(dt) else None
        return row

    @cached_property
    def _moments(self) -> dict[str, dict]:
        """Per column, what the first pass already holds."""
        return {c: self._moment_row(i, c) for i, c in enumerate(self.columns)}

    @cached_property
    def _known_columns(self) -> list[str]:
        """Columns whose cells another analysis has counted, with the same type, tokens and method."""
        if self.known is None:
            return []
        other, columns = self.known
        if self.approx or other.approx or tuple(self.tokens) != tuple(other.tokens):
            return []
        return [c for c in self.columns if c in columns and self.types[c] == other.types.get(c)]

    @cached_property
    def _distinct(self) -> DistinctStats:
        """Distinct counts and modes, when first asked for."""
        return DistinctStats(self)

    @cached_property
    def _quantiles(self) -> dict[str, dict]:
        """Order statistics of the numeric columns, when first asked for."""
        if self.approx:
            return self._distinct.rows
        rows = {c: self.known[0]._quantiles[c] for c in self._known_columns if P.is_numeric(self.types[c]) and c in self.known[0]._quantiles}
        columns = [c for c in self.columns if c not in rows]
        q = quantile_stats(self.both, columns) if columns else None
        return rows if q is None else rows | {r["column"]: r.asDict() for r in q.collect()}

    @cached_property
    def _profile_rows(self):
        """The whole profile (one small row per column)."""
        text_of = {c: self._text_name(c) for c in self.plan.promoted}
        if self.approx:
            schema = profile(self.both, self.columns, text_of=text_of, tokens=self.tokens, approx=True).schema
        else:
            base = profile(self.both, self.columns, text_of=text_of, tokens=self.tokens, with_quantiles=False).schema
            schema = T.StructType(base.fields + [T.StructField(k, T.DoubleType()) for k in QUANTILES])
        return schema, [tuple(self.stats[c].get(f.name) for f in schema.fields) for c in self.columns]

    @cached_property
    def profile_df(self) -> DataFrame:
        """Per-column profile served from the collected rows: later consumers
        (scores, health, classes) do not re-run the three profile passes."""
        schema, rows = self._profile_rows
        return self.raw.sparkSession.createDataFrame(rows, schema)

    @cached_property
    def stats(self) -> dict[str, ColumnStats]:
        return {c: ColumnStats(self, c) for c in self.columns}

    @cached_property
    def date_shares(self) -> DataFrame:
        """``(column, date_share)`` of the text columns: dates among all non-null cells, counted when first asked for."""
        f = self._first
        texts = [(i, c) for i, c in enumerate(self.columns) if P.is_string(self.raw_types[c])]
        dates = {r["column"]: r["dates"] for r in date_counts(self.raw, [c for _, c in texts]).collect()} if texts else {}
        rows = [(c, dates.get(c, 0) / (f["rows"] - f[f"{i}_nulls"]) if f["rows"] > f[f"{i}_nulls"] else None) for i, c in texts]
        return self.raw.sparkSession.createDataFrame(rows, "column string, date_share double")

    @cached_property
    def rows(self) -> int:
        return self._first["rows"] if self.columns else 0

    @cached_property
    def outlier_rules(self) -> dict[str, dict]:
        return {c: outlier_rule(self.stats[c]) for c in self.columns if P.is_numeric(self.types[c])}

    @cached_property
    def _category_columns(self) -> list[str]:
        """Text columns in which some value has several spellings."""
        texts = [c for c in self.columns if P.is_string(self.types[c])]
        if not texts:
            return []
        if self._distinct.counted:  # another result has asked for it already
            several = {c for c in texts if (self.stats[c]["lower_distinct"] or 0) < (self.stats[c]["distinct_nonblank"] or 0)}
        else:
            several = {r["column"] for r in spelling_counts(self.typed, texts).where("spellings > lowered").collect()}
        return [c for c in texts if c in several]

    @cached_property
    def category_table(self) -> DataFrame:
        """``(column, value, dominant, n)`` for every non-dominant spelling,
        computed once; it stays on the executors, whatever its size."""
        cand = self._category_columns
        spark = self.raw.sparkSession
        if not cand:
            return spark.createDataFrame([], "column string, value string, dominant string, n bigint")
        vc = value_counts_long(self.typed.select(*[F.col(P.quoted(c)) for c in cand]))
        vc = vc.where(F.col("v").isNotNull() & (P.strip_ws("v") != ""))
        w = Window.partitionBy("column", F.lower("v")).orderBy(F.desc("cnt"), F.asc("v"))
        # each partition holds the spellings of one lower-cased value
        ranked = vc.select("column", "v", "cnt", F.first("v").over(w).alias("dominant"))
        return pinned(ranked.where(F.col("v") != F.col("dominant")).select(
            "column", F.col("v").alias("value"), "dominant", F.col("cnt").alias("n")))

    def _spelling_name(self, c: str) -> str:
        return f"__spelling_{self.columns.index(c)}"

    @cached_property
    def judged(self) -> DataFrame:
        """``both`` with, for every column of several spellings, whether the
        cell is a non-dominant one: a join with the spelling table."""
        out = self.both
        for c in self._category_columns:
            name = self._spelling_name(c)
            other = self.category_table.where(F.col("column") == c).select(F.col("value").alias(f"{name}_v"), F.lit(True).alias(name))
            out = out.join(other, F.col(P.quoted(c)) == F.col(f"{name}_v"), "left").drop(f"{name}_v")
        return out

    # ---- row predicates ---------------------------------------------------
    def _ignored(self, issue: str, c: str | None = None) -> bool:
        cols = self.ignored.get(issue, [])
        return "all" in cols or (c is not None and c in cols)

    def text_col(self, c: str) -> tuple[Column, object]:
        if c in self.plan.promoted:
            return F.col(self._text_name(c)), self.raw_types[c]
        return F.col(P.quoted(c)), self.types[c]

    def missing_pred(self, c: str) -> Column:
        x, dt = self.text_col(c)
        return P.is_missing(x, dt, self.tokens)

    def empty_pred(self, c: str) -> Column:
        x, dt = self.text_col(c)
        return P.is_empty(x, dt)

    def outlier_pred(self, c: str) -> Column | None:
        rule = self.outlier_rules.get(c)
        if not rule or not rule["method"] or rule["method"] == "None":
            return None
        return outlier_predicate(c, rule)

    def invalid_pred(self, c: str) -> Column | None:
        if c not in self.plan.rows:
            return None
        x = F.col(self._text_name(c)) if c in self.plan.promoted else F.col(P.quoted(c))
        pred = invalid_predicate(c, self.plan, self.raw_types[c], self.tokens)
        if pred is None:
            return None
        if c in self.plan.promoted:  # evaluate on the original text
            dt = self.raw_types[c]
            return P.is_valid(x, dt, self.tokens) & ~P.matches(x, "numeric")
        return pred

    def inconsistent_pred(self, c: str) -> Column | None:
        """Of a row of ``judged``."""
        return F.coalesce(F.col(self._spelling_name(c)), F.lit(False)) if c in self._category_columns else None

    def issue_preds(self, kind: str) -> list[tuple[str, Column]]:
        fn = {"missing": (self.missing_pred, "Missing Values"), "empty": (self.empty_pred, "Empty Cells"),
              "outlier": (self.outlier_pred, "Outliers"), "invalid": (self.invalid_pred, None),
              "inconsistent": (self.inconsistent_pred, None)}[kind]
        out = []
        for c in self.columns:
            if fn[1] and self._ignored(fn[1], c):
                continue
            p = fn[0](c)
            if p is not None:
                out.append((c, p))
        return out

    # ---- duplicates (E9-E11) ----------------------------------------------
    def dup_key(self) -> Column:
        return F.struct(*[normalised(c, self.types[c], self.tokens).alias(c) for c in self.dup_keys])

    def duplicate_keys(self) -> DataFrame:
        """``(_k, n)`` for every normalised row value seen more than once.
        Partial aggregation absorbs hot keys before the shuffle."""
        return (self.both.groupBy(self.dup_key().alias("_k")).agg(F.count(F.lit(1)).alias("n"))
                    .where(F.col("n") > 1))

    def duplicate_rows_total(self) -> DataFrame:
        """Every member of every duplicate group, and the group count
        (computed once)."""
        schema, rows = self._dup_total_rows
        return self.raw.sparkSession.createDataFrame(rows, schema)

    @cached_property
    def _dup_total_rows(self):
        t = self.duplicate_keys().agg(F.coalesce(F.sum("n"), F.lit(0)).alias("duplicate_rows"),
                                      F.count(F.lit(1)).alias("duplicate_groups"))
        return t.schema, t.collect()

    # ---- flag table (I2) ----------------------------------------------------
    def _flags(self, joined: DataFrame, extra: list[str]) -> DataFrame:
        flags = [
            F.coalesce(F.col("_dup"), F.lit(False)).alias("_is_duplicate"),
            P.flagged_names(self.issue_preds("outlier")).alias("_outlier_cols"),
            P.flagged_names(self.issue_preds("empty")).alias("_empty_cols"),
            P.flagged_names(self.issue_preds("missing")).alias("_missing_cols"),
            P.flagged_names(self.issue_preds("invalid")).alias("_invalid_type_cols"),
            P.flagged_names(self.issue_preds("inconsistent")).alias("_inconsistent_category_cols"),
        ]
        return joined.select(*[F.col(P.quoted(c)) for c in [*self.out_cols, *extra]], *flags)

    def _duplicates_ignored(self) -> bool:
        return self._ignored(DUPLICATE_ISSUES[0]) or self._ignored(DUPLICATE_ISSUES[1])

    def flag_frame(self, keep_text: bool = False) -> DataFrame:
        """Every row with its six flags.  Rows meet the repeated keys by a
        128-bit digest of the key (two hashes), so the row travels once."""
        base = self.judged
        if self._duplicates_ignored():
            joined = base.withColumn("_dup", F.lit(False))
        else:
            # hashes pass over nulls, so each cell goes with whether it is null
            cells = [normalised(c, self.types[c], self.tokens) for c in self.dup_keys]
            key = [x for cell in cells for x in (cell, cell.isNull())]
            digest = [F.xxhash64(F.lit(seed), *key).alias(f"_h{seed}") for seed in (1, 2)]
            keys = (self.both.select(*digest).groupBy("_h1", "_h2").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
                        .select("_h1", "_h2", F.lit(True).alias("_dup")))
            joined = base.select("*", *digest).join(keys, ["_h1", "_h2"], "left")
        return self._flags(joined, [self._text_name(c) for c in self.plan.promoted] if keep_text else [])

    def flag_rows(self, rows: DataFrame) -> DataFrame:
        """A few rows of ``both`` (a page; they may carry a row id of their
        own) with their flags.  The whole table is only counted against the
        page's own keys, which are few enough to broadcast."""
        page = pinned(rows)
        more = [c for c in page.columns if c not in self.both.columns]
        out = page
        for c in self._category_columns:
            name = self._spelling_name(c)
            other = self.category_table.where(F.col("column") == c).select(F.col("value").alias(f"{name}_v"), F.lit(True).alias(name))
            out = other.join(F.broadcast(out), F.col(P.quoted(c)) == F.col(f"{name}_v"), "right").drop(f"{name}_v")
        if self._duplicates_ignored():
            joined = out.withColumn("_dup", F.lit(False))
        else:
            keys = page.select(self.dup_key().alias("_pk")).distinct()
            counted = (self.both.select(self.dup_key().alias("_k")).join(F.broadcast(keys), F.col("_k").eqNullSafe(F.col("_pk")))
                           .groupBy("_k").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_k", F.lit(True).alias("_dup")))
            joined = out.withColumn("_key", self.dup_key()).join(counted, F.col("_key").eqNullSafe(F.col("_k")), "left")
        return self._flags(joined, more)

    # ---- per-column issue counts (one aggregate) ---------------------------
    def issue_counts(self) -> DataFrame:
        """``(column, missing, empty, outliers, invalid, inconsistent)``,
        computed once (one aggregate) and served from the collected rows."""
        schema, rows = self._issue_rows
        return self.raw.sparkSession.createDataFrame(rows, schema)

    @cached_property
    def _issue_rows(self):
        t = self._issue_counts_lazy()
        return t.schema, t.collect()

    def _issue_counts_lazy(self, chunk: int = 50) -> DataFrame:
        """Wide tables are counted in chunks of ``chunk`` columns per aggregate."""
        parts = [self._issue_counts_for(self.columns[s:s + chunk]) for s in range(0, len(self.columns), chunk)]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def _issue_counts_for(self, columns) -> DataFrame:
        aggs, at = [], {c: i for i, c in enumerate(columns)}
        for kind in ("missing", "empty", "outlier", "invalid", "inconsistent"):
            for c, p in self.issue_preds(kind):
                if c in columns:
                    aggs.append(F.count_if(p).alias(f"{kind}|{at[c]}"))
        if not aggs:
            aggs = [F.count(F.lit(1)).alias("_rows")]
        row = self.judged.agg(*aggs)
        names = set(row.columns)
        items = []
        for c in columns:
            def get(kind):
                k = f"{kind}|{at[c]}"
                return F.col(f"`{k}`") if k in names else F.lit(0).cast("bigint")
            items.append(F.struct(F.lit(c).alias("column"), get("missing").alias("missing"),
                                  get("empty").alias("empty"), get("outlier").alias("outliers"),
                                  get("invalid").alias("invalid"), get("inconsistent").alias("inconsistent")))
        return row.select(F.inline(F.array(*items)))

    def outlier_table(self) -> DataFrame:
        """``(column, method, lower, upper)`` for numeric columns."""
        rows = [(c, r["method"], r["lower"], r["upper"]) for c, r in self.outlier_rules.items()]
        return self.raw.sparkSession.createDataFrame(
            rows, "column string, method string, lower double, upper double")


def outlier_report(a: Analysis) -> DataFrame:
    """``(column, outliers, outlier_pct, method, lower, upper)`` of the
    numeric columns that have outliers."""
    counts = a.issue_counts().where("outliers > 0").select("column", "outliers")
    return counts.join(a.outlier_table(), "column").select(
        "column", "outliers", F.round(F.col("outliers") / F.lit(float(max(a.rows, 1))) * 100, 2).alias("outlier_pct"), "method", "lower", "upper")


def outlier_preview(a: Analysis, column: str, order: str | None = None, k: int = 5) -> DataFrame:
    """The first ``k`` outlier cells of a column, by ``order`` (the row id, if the table has one)."""
    pred = a.outlier_pred(column)
    order = order or (ROW_ID if ROW_ID in a.out_cols else None)
    if pred is None:
        return a.both.select(F.col(P.quoted(column)).alias("value")).limit(0)
    rows = a.both.where(pred)
    if order:
        return rows.select(F.col(P.quoted(order)).alias(order), F.col(P.quoted(column)).alias("value")).orderBy(order).limit(k)
    return rows.select(F.col(P.quoted(column)).alias("value")).limit(k)


def outlier_extremes(a: Analysis, columns=None) -> DataFrame:
    """Smallest and largest outlier value over ``columns`` (default: all
    numeric columns with a rule) and their columns; ties go to the earlier
    column.  Outlier cells are unpivoted and reduced with ``min_by``/``max_by``
    (a partial aggregate, no sort)."""
    cols = [c for c in (columns or a.columns) if a.outlier_pred(c) is not None]
    spark = a.raw.sparkSession
    schema = ("minimum_outlier_column string, minimum_outlier_value double, largest_outlier_column string, "
              "largest_outlier_value double")
    if not cols:
        return spark.createDataFrame([("None", None, "None", None)], schema)
    items = [F.when(a.outlier_pred(c), F.struct(F.lit(a.columns.index(c)).alias("p"), F.lit(c).alias("c"),
                                                F.col(P.quoted(c)).cast("double").alias("v"))) for c in cols]
    cells = a.both.select(F.explode(F.filter(F.array(*items), lambda x: x.isNotNull())).alias("o"))
    r = cells.agg(F.min_by("o", F.struct(F.col("o.v"), F.col("o.p"))).alias("lo"),
                  F.max_by("o", F.struct(F.col("o.v"), -F.col("o.p"))).alias("hi"))
    return r.select(F.coalesce(F.col("lo.c"), F.lit("None")).alias("minimum_outlier_column"),
                    F.col("lo.v").alias("minimum_outlier_value"),
                    F.coalesce(F.col("hi.c"), F.lit("None")).alias("largest_outlier_column"),
                    F.col("hi.v").alias("largest_outlier_value"))
