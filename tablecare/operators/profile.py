"""Column profile (E1-E8, E12): one small row per column.

Three distributed passes, none of which funnels a column into one task:

A. one wide aggregate: row count, null/missing/empty/valid counts, moments,
   min/max/sum, population skewness;
B. unpivot to ``(column, value)`` and count each value (partial aggregation
   absorbs hot values), then per column: distinct counts (null is a value),
   cells whose value repeats, the mode (count desc, value asc) and the number
   of case-insensitive spellings;
C. exact order statistics: rank selection over the counted values of the
   numeric columns (``quantiles.order_stats``).

The result is a DataFrame of one row per column (bounded by the schema, not
by the data).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..functions import predicates as P
from ..session import pinned
from .quantiles import order_stats

# quantile name -> (q, rule)
QUANTILES = {
    "median": (0.5, "linear"),
    "q1": (0.25, "nearest"),
    "q3": (0.75, "nearest"),
    "p5": (0.05, "nearest"),
    "p90": (0.90, "nearest"),
    "p95": (0.95, "nearest"),
}

PROFILE_SCHEMA = (
    "column string, position int, dtype string, rows bigint, nulls bigint, missing bigint, empty bigint, "
    "valid bigint, n bigint, mean double, std double, min double, max double, sum double, skew double"
)


def _num(c: str, dtype) -> Column:
    """Numeric value with NaN treated as absent and -0.0 folded into 0.0."""
    x = F.col(P.quoted(c)).cast("double")
    return F.when(~F.isnan(x), x + F.lit(0.0))


def moments(df: DataFrame, columns=None, text_of: dict | None = None,
            tokens=P.MISSING_TOKENS) -> DataFrame:
    """Pass A.  ``text_of`` maps a column to another column of ``df`` holding
    its original text, so missing/empty are judged on the text as read."""
    text_of = text_of or {}
    schema = {f.name: f.dataType for f in df.schema.fields}
    columns = [c for c in (columns or df.columns)]
    aggs = [F.count(F.lit(1)).alias("rows")]
    for i, c in enumerate(columns):
        dt = schema[c]
        src, sdt = (text_of[c], T.StringType()) if c in text_of else (c, dt)
        aggs += [
            F.count_if(F.col(P.quoted(c)).isNull()).alias(f"{i}_nulls"),
            F.count_if(P.is_missing(src, sdt, tokens)).alias(f"{i}_missing"),
            F.count_if(P.is_empty(src, sdt)).alias(f"{i}_empty"),
        ]
        if P.is_numeric(dt):
            x = _num(c, dt)
            aggs += [F.count(x).alias(f"{i}_n"), F.avg(x).alias(f"{i}_mean"), F.stddev_samp(x).alias(f"{i}_std"),
                     F.min(x).alias(f"{i}_min"), F.max(x).alias(f"{i}_max"), F.sum(x).alias(f"{i}_sum"),
                     F.skewness(x).alias(f"{i}_skew")]
    row = df.agg(*aggs)
    structs = []
    for i, c in enumerate(columns):
        dt = schema[c]
        num = P.is_numeric(dt)
        nul = lambda t: F.lit(None).cast(t)
        structs.append(F.struct(
            F.lit(c).alias("column"), F.lit(i).alias("position"), F.lit(dt.simpleString()).alias("dtype"),
            F.col("rows"), F.col(f"{i}_nulls").alias("nulls"), F.col(f"{i}_missing").alias("missing"),
            F.col(f"{i}_empty").alias("empty"),
            (F.col("rows") - F.col(f"{i}_missing") - F.col(f"{i}_empty")).alias("valid"),
            (F.col(f"{i}_n") if num else nul("bigint")).alias("n"),
            *[(F.col(f"{i}_{k}") if num else nul("double")).alias(k)
              for k in ("mean", "std", "min", "max", "sum", "skew")],
        ))
    return row.select(F.inline(F.array(*structs)))


def value_counts_long(df: DataFrame, columns=None) -> DataFrame:
    """``(column, v, vn, vi, cnt)``: every distinct value of every column.  ``v``
    is the text (non-numeric columns), ``vn`` the number (numeric columns),
    ``vi`` the exact integer (integral columns)."""
    schema = {f.name: f.dataType for f in df.schema.fields}
    columns = list(columns or df.columns)
    items = []
    for c in columns:
        dt = schema[c]
        if P.is_numeric(dt):
            x = F.col(P.quoted(c)).cast("double") + F.lit(0.0)
            # integers also group on their exact value: doubles merge keys above 2^53
            exact = F.col(P.quoted(c)).cast("bigint") if isinstance(dt, P.INTEGRAL_TYPES) else F.lit(None).cast("bigint")
            items.append(F.struct(F.lit(c).alias("column"), F.lit(None).cast("string").alias("v"), x.alias("vn"),
                                  exact.alias("vi")))
        else:
            items.append(F.struct(F.lit(c).alias("column"), F.col(P.quoted(c)).cast("string").alias("v"),
                                  F.lit(None).cast("double").alias("vn"), F.lit(None).cast("bigint").alias("vi")))
    long = df.select(F.inline(F.array(*items)))
    return long.groupBy("column", "v", "vn", "vi").agg(F.count(F.lit(1)).alias("cnt"))


def distinct_stats(df: DataFrame, columns=None, tokens=P.MISSING_TOKENS) -> DataFrame:
    """Pass B: per column distinct counts, duplicated cells and mode."""
    vc = value_counts_long(df, columns)
    v, vn, cnt = F.col("v"), F.col("vn"), F.col("cnt")
    nonblank = v.isNotNull() & (P.strip_ws(v) != "")
    valid_text = nonblank & ~F.lower(P.strip_ws(v)).isin(*tokens)
    valid_num = vn.isNotNull() & ~F.isnan(vn)
    return vc.groupBy("column").agg(
        F.count(F.lit(1)).alias("distinct"),
        F.count_if(v.isNotNull() | vn.isNotNull()).alias("distinct_nonnull"),
        F.count_if(nonblank).alias("distinct_nonblank"),
        F.count_distinct(F.when(nonblank, F.lower(v))).alias("lower_distinct"),
        F.coalesce(F.sum(F.when(cnt > 1, cnt)), F.lit(0)).alias("dup_cells"),
        F.coalesce(
            F.min_by(v, F.when(valid_text, F.struct((-cnt).alias("c"), v.alias("x")))),
            F.min_by(vn, F.when(valid_num, F.struct((-cnt).alias("c"), vn.alias("x")))).cast("string"),
        ).alias("mode"),
        F.min_by(vn, F.when(valid_num, F.struct((-cnt).alias("c"), vn.alias("x")))).alias("mode_num"),
    )


#: Values a heavy-hitter sketch tracks.  Its counts are off by 3.5 / 16,384 of the rows at most (its table has room for
#: 16,384), and it names what surely has more than that: no other value is more frequent than ``LOST`` of the rows.
TRACKED = 10_000
LOST = 7 / 16_384


def _mode_cells(df: DataFrame, columns, tokens) -> DataFrame:
    """``(i, v, vn)``: the cells of ``columns`` that may be a mode, text or number."""
    schema = {f.name: f.dataType for f in df.schema.fields}
    items = []
    for i, c in enumerate(columns):
        x, num = F.col(P.quoted(c)), P.is_numeric(schema[c])
        items.append(F.struct(F.lit(i).alias("i"), (F.lit(None) if num else x).cast("string").alias("v"),
                              (x if num else F.lit(None)).cast("double").alias("vn")))
    cells = df.select(F.inline(F.array(*items)))
    text = F.col("v").isNotNull() & (P.strip_ws("v") != "") & ~F.lower(P.strip_ws("v")).isin(*tokens)
    return cells.where(text | (F.col("vn").isNotNull() & ~F.isnan("vn"))).select("i", "v", (F.col("vn") + F.lit(0.0)).alias("vn"))


def modes(df: DataFrame, columns, tokens=P.MISSING_TOKENS) -> dict[str, tuple[str | None, float | None, int]]:
    """``column -> (mode as text, mode as number, its count)`` (count desc, value asc), exact.

    A mergeable heavy-hitter sketch of bounded size names the values that can be a column's mode, a second scan counts
    those alone.  A value that the sketch lost occurs in at most ``LOST`` of the rows; where the best candidate has more,
    it is proved to be the mode.  Only columns without such a value (all their values are rare) are counted whole."""
    if not columns:
        return {}
    cells = _mode_cells(df, columns, tokens)
    sketched = pinned(cells.groupBy("i").agg(
        F.count(F.lit(1)).alias("n"), F.expr(f"approx_top_k(v, {TRACKED}, {TRACKED})").alias("texts"),
        F.expr(f"approx_top_k(vn, {TRACKED}, {TRACKED})").alias("numbers")))
    rows = {r.i: r.n for r in sketched.select("i", "n").collect()}
    pick = [F.struct(F.col("x.item").cast("string").alias("v"), F.lit(None).cast("double").alias("vn"), F.col("x.count").alias("c")),
            F.struct(F.lit(None).cast("string").alias("v"), F.col("x.item").cast("double").alias("vn"), F.col("x.count").alias("c"))]
    named = [sketched.select("i", "n", F.explode(k).alias("x")).select("i", "n", p.alias("x")).select("i", "n", "x.*")
             for k, p in zip(("texts", "numbers"), pick)]
    named = named[0].unionByName(named[1]).where("v IS NOT NULL OR vn IS NOT NULL")
    best = Window.partitionBy("i")
    # at most TRACKED rows a column; estimates are off by less than LOST
    likely = pinned(named.withColumn("_top", F.max("c").over(best)).where(F.col("c") >= F.col("_top") - F.ceil(F.col("n") * LOST)))
    likely = likely.select(F.col("i").alias("_i"), F.col("v").alias("_v"), F.col("vn").alias("_vn"), "n")
    met = cells.join(F.broadcast(likely), (F.col("i") == F.col("_i")) & F.col("v").eqNullSafe(F.col("_v")) & F.col("vn").eqNullSafe(F.col("_vn")))
    counted = met.groupBy("i", "n", "v", "vn").agg(F.count(F.lit(1)).alias("c"))
    top = counted.groupBy("i", "n").agg(F.min(F.struct((-F.col("c")).alias("less"), "v", "vn")).alias("t")).collect()
    out = {c: (None, None, 0) for c in columns}
    for r in top:
        if -r.t.less > r.n * LOST:
            out[columns[r.i]] = (r.t.v, r.t.vn, -r.t.less)
    flat = [columns[i] for i in sorted(rows) if out[columns[i]][2] == 0]
    if flat:  # every value is rare
        vc = _mode_cells(df, flat, tokens).groupBy("i", "v", "vn").agg(F.count(F.lit(1)).alias("c"))
        for r in vc.groupBy("i").agg(F.min(F.struct((-F.col("c")).alias("less"), "v", "vn")).alias("t")).collect():
            out[flat[r.i]] = (r.t.v, r.t.vn, -r.t.less)
    return out


def spelling_counts(df: DataFrame, columns) -> DataFrame:
    """``(column, spellings, lowered)`` of text columns: distinct texts that aren't blank, and their distinct
    lower-cased forms.  Only these columns' texts are shuffled."""
    cells = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(P.quoted(c)).alias("v")) for c in columns])))
    texts = cells.where(F.col("v").isNotNull() & (P.strip_ws("v") != "")).groupBy("column", "v").agg(F.count(F.lit(1)).alias("_n"))
    return texts.groupBy("column", F.lower("v").alias("l")).agg(F.count(F.lit(1)).alias("_n")).groupBy("column").agg(
        F.sum("_n").alias("spellings"), F.count(F.lit(1)).alias("lowered"))


def quantile_stats(df: DataFrame, columns=None, qs=None) -> DataFrame | None:
    """Pass C over the numeric columns: exact order statistics of their counted
    values (``quantiles.order_stats``), at every size by the same plan."""
    schema = {f.name: f.dataType for f in df.schema.fields}
    nums = [c for c in (columns or df.columns) if P.is_numeric(schema[c])]
    if not nums:
        return None
    # rank on a small int key; names are attached to the one-row-per-column result
    long = df.select(F.inline(F.array(*[
        F.struct(F.lit(i).alias("_ci"), F.col(P.quoted(c)).cast("double").alias("_x")) for i, c in enumerate(nums)])))
    st = order_stats(long, ["_ci"], "_x", qs or QUANTILES).drop("n")
    names = F.element_at(F.array(*[F.lit(c) for c in nums]), F.col("_ci") + 1)
    return st.select(names.alias("column"), *[c for c in st.columns if c != "_ci"])


def approx_stats(df: DataFrame, columns=None, tokens=P.MISSING_TOKENS, accuracy: int = 10000) -> DataFrame:
    """Passes B and C in bounded memory, as ONE aggregate: HyperLogLog
    distinct counts and ``percentile_approx`` quantiles (rank error about
    ``1/accuracy``).  Modes and repeated-cell counts are not derived."""
    schema = {f.name: f.dataType for f in df.schema.fields}
    columns = list(columns or df.columns)
    aggs = []
    for i, c in enumerate(columns):
        dt, x = schema[c], F.col(P.quoted(c))
        nonblank = x.isNotNull() & (P.strip_ws(x.cast("string")) != "")
        aggs += [F.approx_count_distinct(x, 0.01).alias(f"{i}_d"), F.max(x.isNull().cast("int")).alias(f"{i}_hasnull"),
                 F.approx_count_distinct(F.when(nonblank, x.cast("string")), 0.01).alias(f"{i}_db"),
                 F.approx_count_distinct(F.when(nonblank, F.lower(x.cast("string"))), 0.01).alias(f"{i}_dl")]
        if P.is_numeric(dt):
            v = _num(c, dt)
            near = [q for q, rule in QUANTILES.values() if rule == "nearest"]
            aggs += [F.percentile_approx(v, near, accuracy).alias(f"{i}_q"),
                     F.percentile_approx(v, 0.5, accuracy).alias(f"{i}_med")]
    row = df.agg(*aggs)
    items = []
    near_names = [k for k, (q, rule) in QUANTILES.items() if rule == "nearest"]
    for i, c in enumerate(columns):
        num = P.is_numeric(schema[c])
        qv = {k: (F.col(f"{i}_q")[j] if num else F.lit(None).cast("double")) for j, k in enumerate(near_names)}
        items.append(F.struct(
            F.lit(c).alias("column"),
            (F.col(f"{i}_d") + F.coalesce(F.col(f"{i}_hasnull"), F.lit(0))).alias("distinct"),
            F.col(f"{i}_d").alias("distinct_nonnull"), F.col(f"{i}_db").alias("distinct_nonblank"),
            F.col(f"{i}_dl").alias("lower_distinct"), F.lit(None).cast("bigint").alias("dup_cells"),
            F.lit(None).cast("string").alias("mode"), F.lit(None).cast("double").alias("mode_num"),
            (F.col(f"{i}_med").cast("double") if num else F.lit(None).cast("double")).alias("median"),
            *[qv[k].cast("double").alias(k) for k in near_names]))
    return row.select(F.inline(F.array(*items)))


def profile(df: DataFrame, columns=None, text_of: dict | None = None, tokens=P.MISSING_TOKENS,
            with_distinct: bool = True, with_quantiles: bool = True, approx: bool = False) -> DataFrame:
    """One row per column (ordered by ``position``) with every statistic the
    quality, cleaning and dashboard operators use.  ``approx=True`` replaces
    the exact distinct/quantile passes by one bounded-memory aggregate."""
    columns = list(columns or [c for c in df.columns if c not in (text_of or {}).values()])
    out = moments(df, columns, text_of, tokens)
    if approx:
        return out.join(approx_stats(df, columns, tokens), "column", "left").orderBy("position")
    if with_distinct:
        out = out.join(distinct_stats(df, columns, tokens), "column", "left")
    if with_quantiles:
        q = quantile_stats(df, columns)
        if q is not None:
            out = out.join(q, "column", "left")
        else:
            for k in QUANTILES:
                out = out.withColumn(k, F.lit(None).cast("double"))
    return out.orderBy("position")


def reprofile(df: DataFrame, old: DataFrame, columns, text_of: dict | None = None,
              tokens=P.MISSING_TOKENS) -> DataFrame:
    """Refresh the profile rows of ``columns`` only (column pruning keeps
    the scan to those columns); the other rows are kept.  When the row count
    changed, every column is profiled again."""
    cols = [c for c in columns if c in df.columns]
    old_rows = old.agg(F.max("rows")).first()[0]
    fresh = profile(df, cols or None, text_of=text_of, tokens=tokens)
    if not cols or fresh.agg(F.max("rows")).first()[0] != old_rows:
        return profile(df, text_of=text_of, tokens=tokens)
    pos = {c: i for i, c in enumerate(df.columns)}
    fresh = fresh.withColumn("position", F.element_at(F.array(*[F.lit(pos[c]) for c in cols]),
                                                      F.array_position(F.array(*[F.lit(c) for c in cols]),
                                                                       F.col("column")).cast("int")))
    keep = old.where(~F.col("column").isin(cols) & F.col("column").isin(list(df.columns)))
    return keep.unionByName(fresh, allowMissingColumns=True).orderBy("position")


MOMENT_KEYS = ("n", "mean", "std", "min", "max", "sum", "skew")


def _moment_aggs(x, p: str) -> list:
    return [F.count(x).alias(f"{p}_n"), F.avg(x).alias(f"{p}_mean"), F.stddev_samp(x).alias(f"{p}_std"),
            F.min(x).alias(f"{p}_min"), F.max(x).alias(f"{p}_max"), F.sum(x).alias(f"{p}_sum"),
            F.skewness(x).alias(f"{p}_skew")]


def first_pass(df: DataFrame, columns=None, tokens=P.MISSING_TOKENS, kinds=("numeric", "email", "phone"),
               chunk: int = 50) -> dict:
    """Type evidence and moments in ONE aggregate over the table as read.

    Wide tables are read once per ``chunk`` columns, with the same results.

    Per column: null/missing/empty counts on the cells as read; moments of
    numeric columns; for text columns the pattern counts that decide
    promotion and the invalid-type pattern, plus the moments (and null
    count) of their numeral reading -- so the promoted column's statistics
    need no second scan.  Returns the single collected row as a dict."""
    from .infer import numeral_to_double
    schema = {f.name: f.dataType for f in df.schema.fields}
    columns = list(columns or df.columns)
    if len(columns) > chunk:
        # wide tables: one aggregate per chunk keeps generated code small
        out: dict = {}
        for start in range(0, len(columns), chunk):
            part = first_pass(df, columns[start:start + chunk], tokens, kinds, chunk)
            out["rows"] = part.pop("rows")
            for k, v in part.items():
                i, rest = k.split("_", 1)
                out[f"{int(i) + start}_{rest}"] = v
        return out
    aggs = [F.count(F.lit(1)).alias("rows")]
    for i, c in enumerate(columns):
        dt, x = schema[c], F.col(P.quoted(c))
        aggs += [F.count_if(x.isNull()).alias(f"{i}_nulls"),
                 F.count_if(P.is_missing(c, dt, tokens)).alias(f"{i}_missing"),
                 F.count_if(P.is_empty(c, dt)).alias(f"{i}_empty")]
        if P.is_numeric(dt):
            aggs += _moment_aggs(_num(c, dt), f"{i}")
        elif P.is_string(dt):
            valid = P.is_valid(c, dt, tokens)
            nonblank = x.isNotNull() & (P.strip_ws(x) != "")
            aggs += [F.count_if(valid).alias(f"{i}_v"), F.count_if(valid & P.matches(x, "numeric")).alias(f"{i}_vn"),
                     F.count_if(nonblank).alias(f"{i}_b")]
            aggs += [F.count_if(nonblank & P.matches(x, k)).alias(f"{i}_b{k}") for k in kinds]
            num = numeral_to_double(x)
            aggs += [F.count_if(num.isNull()).alias(f"{i}_xnulls")] + _moment_aggs(num, f"{i}_x")
    return df.agg(*aggs).first().asDict()
