"""Chart aggregates (E15-E30, B17): every chart is a small DataFrame computed
over the whole table with built-in aggregates; only raw-point charts sample,
and only the correlations of wide tables multiply Arrow batches with numpy.

Ties are broken deterministically (count/value desc, then key asc, nulls last).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import predicates as P
from .quantiles import order_stats

q = P.quoted
#: Columns of a pivoted matrix at most.
MOST_COLUMNS = 10_000
#: Columns whose pairs are correlated as aggregates of one plan.
WIDE = 16


def _c(c) -> Column:
    return F.col(q(c)) if isinstance(c, str) else c


def value_counts(df: DataFrame, col: str, k: int | None = 10, null_label: str | None = None,
                 counted: DataFrame | None = None) -> DataFrame:
    """``(col, count)`` by count desc; null is a group (optionally labelled).
    ``counted``: the counts of all values, where a cube has them."""
    g = counted if counted is not None else df.groupBy(q(col)).agg(F.count(F.lit(1)).alias("count"))
    g = g.orderBy(F.desc("count"), F.asc_nulls_last(q(col)))
    if k:
        g = g.limit(k)
    if null_label is not None:
        g = g.select(F.coalesce(F.col(q(col)).cast("string"), F.lit(null_label)).alias(col), "count")
    return g


def sum_by(df: DataFrame, cat: str, num: str, k: int | None = 15, null_label: str | None = None,
           summed: DataFrame | None = None) -> DataFrame:
    """``(cat, num)`` = total of ``num`` per category, largest first; null is a group (optionally labelled).
    ``summed``: the totals of all categories, where a cube has them."""
    g = summed if summed is not None else df.groupBy(q(cat)).agg(F.coalesce(F.sum(q(num)), F.lit(0)).alias(num))
    g = g.orderBy(F.desc(q(num)), F.asc_nulls_last(q(cat)))
    g = g.limit(k) if k else g
    if null_label is not None:
        g = g.select(F.coalesce(F.col(q(cat)).cast("string"), F.lit(null_label)).alias(cat), q(num))
    return g


def sum_by_date(df: DataFrame, date: str, num: str, last: int | None = 50, summed: DataFrame | None = None) -> DataFrame:
    """Totals per date over non-null dates, ascending, the last ``last`` dates.
    ``summed``: the totals of all dates, where a cube has them."""
    dated = (summed if summed is not None else df).where(F.col(q(date)).isNotNull())
    g = dated if summed is not None else dated.groupBy(q(date)).agg(F.coalesce(F.sum(q(num)), F.lit(0)).alias(num))
    if last:
        g = g.orderBy(F.desc(q(date))).limit(last)
    return g.orderBy(q(date))


def sum_matrix(df: DataFrame, c1: str, c2: str, num: str, pivot: bool = False) -> DataFrame:
    """Totals per pair of categories; ``pivot=True`` for the matrix
    display, whose columns are the values of ``c2``: more than ``MOST_COLUMNS``
    raise a ValueError (take the long form)."""
    if pivot:  # the values become columns, so they are listed first
        listed = df.select(q(c2)).distinct().limit(MOST_COLUMNS + 1).orderBy(F.asc_nulls_last(q(c2))).collect()
        if len(listed) > MOST_COLUMNS:
            raise ValueError(f"{c2!r} has more than {MOST_COLUMNS} values, too many columns for a matrix")
        values = [r[0] for r in listed]
        return df.groupBy(q(c1)).pivot(q(c2), values).agg(F.coalesce(F.sum(q(num)), F.lit(0))).na.fill(0)
    return df.groupBy(q(c1), q(c2)).agg(F.coalesce(F.sum(q(num)), F.lit(0)).alias(num))


def mean_by(df: DataFrame, cat: str, num: str, k: int = 20, min_cv: float = 0.05) -> DataFrame:
    """Mean per category (null categories dropped), top ``k`` by mean; the
    chart is kept only when the group means vary (|std/mean| > ``min_cv``)."""
    g = (df.where(F.col(q(cat)).isNotNull()).groupBy(q(cat)).agg(F.avg(q(num)).alias(num))
           .where(F.col(q(num)).isNotNull()).orderBy(F.desc(q(num)), F.asc(q(cat))).limit(k))
    w = Window.partitionBy()  # over the <= k kept rows
    cv = F.try_divide(F.stddev_samp(q(num)).over(w), F.avg(q(num)).over(w))
    return g.withColumn("cv", cv).where(F.abs(F.coalesce(F.col("cv"), F.lit(0.0))) > min_cv)


def month_spine(df: DataFrame, ts: str) -> DataFrame:
    """Every calendar month end between the first and last date (one row per month)."""
    b = df.agg(F.min(q(ts)).alias("_a"), F.max(q(ts)).alias("_b"))
    return b.select(F.explode(F.sequence(F.trunc(F.to_date("_a"), "month"), F.trunc(F.to_date("_b"), "month"),
                                         F.expr("INTERVAL 1 MONTH"))).alias("_m")).select(
        F.last_day("_m").alias("month"))


def monthly_mean(df: DataFrame, ts: str, num: str) -> DataFrame:
    """``(month, num)``: mean per calendar month end; empty months kept as null."""
    d = df.where(F.col(q(ts)).isNotNull())
    means = d.groupBy(F.last_day(F.to_date(q(ts))).alias("month")).agg(F.avg(q(num)).alias(num))
    return month_spine(d, ts).join(means, "month", "left").orderBy("month")


def trend_summary(monthly: DataFrame, num: str, min_cv: float = 0.05, min_change: float = 5.0) -> DataFrame:
    """One row: months, first/last mean, % change, peak month, cv, keep flag."""
    s = monthly.agg(
        F.count(F.lit(1)).alias("months"),
        F.min_by(q(num), "month").alias("first"), F.max_by(q(num), "month").alias("last"),
        F.min_by("month", F.struct(F.when(F.col(q(num)).isNotNull(), -F.col(q(num))).alias("v"), F.col("month"))
                 ).alias("peak_month"),
        F.stddev_samp(q(num)).alias("_sd"), F.avg(q(num)).alias("_mu"))
    chg = F.when(F.col("first").isNotNull() & (F.col("first") != 0),
                 (F.col("last") - F.col("first")) / F.col("first") * 100).otherwise(F.lit(0.0))
    cv = F.when(F.col("_mu") != 0, F.abs(F.col("_sd") / F.col("_mu"))).otherwise(F.lit(0.0))
    out = s.select("months", "first", "last", chg.alias("pct_change"), "peak_month", cv.alias("cv"))
    return out.withColumn("keep", (F.col("months") >= 2) &
                          ~((F.coalesce(F.col("cv"), F.lit(0.0)) < min_cv) & (F.abs(F.col("pct_change")) < min_change)))


def crosstab(df: DataFrame, x: str, y: str, rows: int = 15) -> DataFrame:
    """Long ``(x, y, n)``, zero-filled, first ``rows`` x values in sort
    order; null x or y rows are left out.  Any number of y values: the zeros
    come from the list of y values, each beside the ``rows`` x values."""
    d = df.where(F.col(q(x)).isNotNull() & F.col(q(y)).isNotNull())
    first = d.select(q(x)).distinct().orderBy(q(x)).limit(rows)
    ys = d.select(F.col(q(y)).cast("string").alias(y)).distinct()
    xs = [r[0] for r in first.collect()]                                # at most ``rows`` values
    if not xs:
        return d.select(F.col(q(x)), F.col(q(y)).cast("string"), F.lit(0).cast("bigint").alias("n")).limit(0)
    kind = d.schema[x].dataType
    cells = ys.select(F.explode(F.array(*[F.lit(v).cast(kind) for v in xs])).alias(x), q(y))
    counted = d.join(F.broadcast(first), x, "left_semi").groupBy(q(x), F.col(q(y)).cast("string").alias(y)).agg(F.count(F.lit(1)).alias("n"))
    return cells.join(counted, [x, y], "left").select(q(x), q(y), F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def comoments(df: DataFrame, cols) -> DataFrame:
    """``(i, j, n, sx, sy, sxx, syy, sxy, odd)`` for every pair ``i <= j`` of
    columns (by number): over the rows where both are given, their count, sums,
    sums of squares and products, of values less the column's mean over the
    whole table; ``odd`` counts rows with a NaN or infinite value, which the
    sums leave out.  A task multiplies its rows block by block and gives one row
    a pair; these add up in one aggregate, whatever the rows."""
    cols = list(cols)
    shown = df.select(*[F.col(q(c)).cast("double").alias(f"c{i}") for i, c in enumerate(cols)])
    finite = [F.when(F.abs(F.col(c)) < float("inf"), F.col(c)) for c in shown.columns]
    means = shown.agg(*[F.coalesce(F.avg(c), F.lit(0.0)) for c in finite]).first()
    centre, width = np.array(means, float), len(cols)

    def add_up(batches):
        total = np.zeros((5, width, width))
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                given = np.column_stack([c.is_valid().to_numpy(zero_copy_only=False) for c in part.columns]).astype(float)
                x = np.column_stack([c.fill_null(0.0).to_numpy(zero_copy_only=False) for c in part.columns])
                odd = ~np.isfinite(x)
                x = np.where(odd | (given == 0), 0.0, x - centre)
                total += (given.T @ given, x.T @ given, (x * x).T @ given, x.T @ x, odd.astype(float).T @ given)
        n, s, ss, sxy, odd = total
        i, j = np.triu_indices(width)
        keep = n[i, j] > 0
        i, j = i[keep], j[keep]
        values = (i, j, n[i, j], s[i, j], s[j, i], ss[i, j], ss[j, i], sxy[i, j], odd[i, j] + odd[j, i])
        names = ("i", "j", "n", "sx", "sy", "sxx", "syy", "sxy", "odd")
        yield pa.RecordBatch.from_arrays([pa.array(v, pa.int32() if k in "ij" else pa.float64()) for k, v in zip(names, values)], names=names)

    numbers = ("n", "sx", "sy", "sxx", "syy", "sxy", "odd")
    rows = shown.mapInArrow(add_up, "i int, j int, " + ", ".join(f"{k} double" for k in numbers))
    return rows.groupBy("i", "j").agg(*[F.sum(k).alias(k) for k in numbers])


def _wide_corr(df: DataFrame, cols: list, digits: int) -> DataFrame:
    m, n = comoments(df, cols), F.col("n")
    vx, vy = F.col("sxx") - F.col("sx") * F.col("sx") / n, F.col("syy") - F.col("sy") * F.col("sy") / n
    # what rounding leaves of a constant column's variance counts as none
    varies = (n > 1) & (vx > 1e-12 * F.col("sxx")) & (vy > 1e-12 * F.col("syy"))
    r = F.when(F.col("odd") > 0, F.lit(float("nan"))).when(varies, (F.col("sxy") - F.col("sx") * F.col("sy") / n) / F.sqrt(vx * vy))
    r = F.round(r, digits)
    got = m.select("i", "j", r.alias("r")).select(F.explode(F.array_distinct(F.array(
        F.struct("i", "j", "r"), F.struct(F.col("j").alias("i"), F.col("i").alias("j"), "r")))).alias("p")).select("p.*")
    names = F.array(*[F.lit(c) for c in cols])
    every = df.sparkSession.range(len(cols) ** 2).selectExpr(f"CAST(id DIV {len(cols)} AS int) AS i", f"CAST(id % {len(cols)} AS int) AS j")
    return every.join(got, ["i", "j"], "left").select(F.get(names, F.col("i")).alias("x"), F.get(names, F.col("j")).alias("y"),
                                                     (F.coalesce("r", F.lit(0.0)) + F.lit(0.0)).alias("r"))


def corr_matrix(df: DataFrame, cols, digits: int = 2) -> DataFrame:
    """``(x, y, r)`` for every ordered pair (diagonal included),
    pairwise-complete Pearson r over the whole table, rounded; undefined -> 0.
    One aggregate; the ratio is guarded so a constant column gives 0, not an
    ANSI division error.  More than ``WIDE`` columns go through ``comoments``,
    whose plan does not grow with the pairs."""
    cols = list(cols)
    if len(cols) > WIDE:
        return _wide_corr(df, cols, digits)
    aggs = []
    for i, a in enumerate(cols):
        for j, b in enumerate(cols):
            if j < i:
                continue
            xa = F.when(F.col(q(b)).isNotNull(), F.col(q(a)).cast("double"))
            xb = F.when(F.col(q(a)).isNotNull(), F.col(q(b)).cast("double"))
            r = F.try_divide(F.covar_samp(xa, xb), F.stddev_samp(xa) * F.stddev_samp(xb))
            aggs.append(r.alias(f"r{i}_{j}"))
    row = df.agg(*aggs)
    items = []
    for i, a in enumerate(cols):
        for j, b in enumerate(cols):
            k = f"r{min(i, j)}_{max(i, j)}"
            v = F.coalesce(F.round(F.col(k), digits), F.lit(0.0)) + F.lit(0.0)
            items.append(F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), v.alias("r")))
    return row.select(F.inline(F.array(*items)))


def strongest_pair(corr: DataFrame, min_abs: float = 0.3) -> DataFrame:
    """Strongest off-diagonal pair (upper triangle order) if |r| > ``min_abs``."""
    off = corr.where(F.col("x") < F.col("y"))
    return off.orderBy(F.desc(F.abs("r")), "x", "y").limit(1).where(F.abs("r") > min_abs)


def histogram(df: DataFrame, col: str, bins: int = 20, closed: str = "right") -> DataFrame:
    """``(bin, lo, hi, n)`` for every bin (empty bins count 0).

    ``right``: bins ``(lo, hi]``, the first edge lowered by 0.1 % of the range;
    ``left``: bins ``[lo, hi)``, the last one closed.  Half-open either way, so
    a value is counted once.  Min and max enter as scalar subqueries."""
    x = F.col(q(col)).cast("double")
    d = df.select(x.alias("_x")).where(F.col("_x").isNotNull() & ~F.isnan("_x"))
    mn = d.agg(F.min("_x")).scalar()
    mx = d.agg(F.max("_x")).scalar()
    w = (mx - mn) / F.lit(float(bins))
    if closed == "right":
        raw = F.ceil(F.try_divide(F.col("_x") - mn, w))
        b = F.when(w == 0, F.lit(bins // 2)).otherwise(F.greatest(F.lit(1), F.least(F.lit(bins), raw)))
    else:
        raw = F.floor(F.try_divide(F.col("_x") - mn, w)) + 1
        b = F.when(w == 0, F.lit(1)).otherwise(F.least(F.lit(bins), F.greatest(F.lit(1), raw)))
    counts = d.groupBy(b.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    spine = d.sparkSession.range(1, bins + 1).select(F.col("id").cast("int").alias("bin"))
    lo = mn + (F.col("bin") - 1) * w
    if closed == "right":
        lo = F.when(F.col("bin") == 1, mn - (mx - mn) * 0.001).otherwise(lo)
    hi = F.when(F.col("bin") == bins, mx).otherwise(mn + F.col("bin") * w)
    return (spine.join(counts, "bin", "left")
                 .select("bin", lo.alias("lo"), hi.alias("hi"), F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))
                 .where(F.col("lo").isNotNull()))


def peak_bin(hist: DataFrame) -> DataFrame:
    """Fullest bin and its share of all counted values."""
    return hist.agg(F.max_by(F.struct("bin", "lo", "hi", "n"), F.struct("n", -F.col("bin"))).alias("p"),
                    F.sum("n").alias("total")).select(
        "p.bin", "p.lo", "p.hi", "p.n", (F.col("p.n") / F.col("total") * 100).alias("share_pct"))


def box_summary(df: DataFrame, cat: str, num: str, k: int = 15) -> DataFrame:
    """``(cat, min, q1, median, q3, max, n)`` per category (first ``k``
    categories in sort order), quartiles as ``sorted[floor(n*q)]``.  Exact,
    by rank selection: a hot category never lands on one task."""
    d = df.where(F.col(q(cat)).isNotNull() & F.col(q(num)).isNotNull())
    cats = d.select(q(cat)).distinct().orderBy(q(cat)).limit(k)          # <= k rows
    d = d.join(F.broadcast(cats), cat, "left_semi")
    qs = {"q1": (0.25, "floor_n"), "median": (0.5, "floor_n"), "q3": (0.75, "floor_n")}
    st = order_stats(d, [cat], num, qs)
    mm = d.groupBy(q(cat)).agg(F.min(F.col(q(num)).cast("double")).alias("min"),
                            F.max(F.col(q(num)).cast("double")).alias("max"))
    return st.join(mm, cat).select(q(cat), "min", "q1", "median", "q3", "max", "n")


def upper_anomalies(df: DataFrame, cols, min_n: int = 10) -> DataFrame:
    """Per column, values above mean + 3 std (columns with > ``min_n``
    values and a positive std).  Mean and std enter as scalar subqueries."""
    cols = list(cols)
    if not cols:
        return df.sparkSession.createDataFrame([], "column string, anomalies bigint")
    aggs, items = [], []
    for i, c in enumerate(cols):
        x = F.col(q(c)).cast("double")
        m, s_ = df.agg(F.avg(x)).scalar(), df.agg(F.stddev_samp(x)).scalar()
        aggs += [F.count_if(x > m + 3 * s_).alias(f"a{i}"), F.count(x).alias(f"n{i}"), F.stddev_samp(x).alias(f"s{i}")]
        items.append(F.struct(F.lit(c).alias("column"), F.col(f"a{i}").alias("anomalies"),
                              F.col(f"n{i}").alias("_n"), F.col(f"s{i}").alias("_s")))
    return (df.agg(*aggs).select(F.inline(F.array(*items)))
              .where((F.col("_n") > min_n) & (F.col("_s") > 0)).select("column", "anomalies"))


def count_matching(df: DataFrame, col: str, term: str) -> Column:
    """Case-insensitive substring count, as an aggregate expression."""
    return F.count_if(F.lower(F.col(q(col)).cast("string")).contains(term.lower()))


def scatter_sample(df: DataFrame, x: str, y: str, n: int = 500, seed: int = 42, key: list[str] | None = None) -> DataFrame:
    """A sample of complete (x, y) points.  Every row draws its own number,
    so equal points are in or out one by one, and the ``n`` smallest numbers
    win (a top-k, no full sort).  With ``key``, columns that tell rows apart,
    the number is the md5 of the seed and the key, and the sample depends on
    the rows alone; without, it comes from a seeded generator, and the same
    table read in the same splits gives the same sample."""
    xs, ys = F.col(P.quoted(x)), F.col(P.quoted(y))
    draw = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(P.quoted(k)).cast("string") for k in key])) if key else F.rand(seed)
    d = df.where(xs.isNotNull() & ys.isNotNull()).select(xs.alias(x), ys.alias(y), draw.alias("_draw"))
    return d.orderBy("_draw", q(x), q(y)).limit(n).drop("_draw")
