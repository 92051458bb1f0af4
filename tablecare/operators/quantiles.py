"""Exact order statistics without one task per group.

``percentile``/``percentile_disc``/``mode`` keep a map of every distinct value
of a group and merge it on one task: unbounded for a hot or high-cardinality
group.  Two plans avoid it.

*Brackets* (``order_stats``).  A mergeable quantile sketch (``percentile_approx``,
of bounded size) brackets each wanted rank from both sides.  While a bracket
holds more than ``MOST_INSIDE`` values, another scan counts exactly what lies
below and inside it and sketches its inside again, so it shrinks by the
sketch's accuracy each time.  The last scan counts what is below and the values
inside, and the value that holds the rank follows.  What is shuffled are
sketches and at most ``MOST_INSIDE`` counted values a rank, however many rows
there are.  A bracket that misses its rank shows in the counts; then ranks
decide.

*Ranks* (``order_stats_of``).  Equal values are counted first (partial aggregation takes a value
that fills most of a column down to one row per task), the distinct
``(group, value, count)`` rows are range-partitioned on ``(group, value)``,
running sums of the counts inside each partition plus a prefix sum over the
small ``(partition, group)`` table give each value its first rank, and only the
values that hold a wanted rank are kept.  A task gets an even share of the
distinct values however the rows are spread over groups or values.

Rank rules (0-based ``k`` over the ``n`` non-null values of a group, ascending):
* ``nearest`` -- ``k = floor(q*(n-1) + 0.5)`` (round half away from zero);
* ``linear`` -- interpolate between ``floor(h)`` and ``ceil(h)``, ``h = q*(n-1)``;
* ``floor_n`` -- ``k = floor(q*n)`` capped at ``n-1`` (box-plot rule).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.predicates import quoted
from ..session import pinned
from .rowid import _n_partitions


def value_counts(df: DataFrame, groups: list[str], value: str) -> DataFrame:
    """``(groups..., _v, _c)``: every non-null, non-NaN value of a group and how often it occurs."""
    v = F.col(value)
    keep = v.isNotNull() & ~F.isnan(v.cast("double"))
    for g in groups:  # rows without a group are not ranked
        keep = keep & F.col(g).isNotNull()
    return (df.select(*groups, (v.cast("double") + F.lit(0.0)).alias("_v")).where(keep)
              .groupBy(*groups, "_v").agg(F.count(F.lit(1)).alias("_c")))


def ranked(counts: DataFrame, groups: list[str], n_partitions: int | None = None) -> DataFrame:
    """``counts`` (groups, ``_v``, ``_c``) with ``_rank``, the 0-based rank of a
    value's first copy in its group, and the group's size ``_n``."""
    keys = [F.col(g) for g in groups] + [F.col("_v")]
    # counting and ranking must see the same range boundaries
    s = pinned(counts.repartitionByRange(_n_partitions(counts, n_partitions), *keys).withColumn("_qp", F.spark_partition_id()))
    part = s.groupBy("_qp", *groups).agg(F.sum("_c").alias("_qc"))
    w_prev = Window.partitionBy(*groups).orderBy("_qp").rowsBetween(Window.unboundedPreceding, -1) if groups \
        else Window.orderBy("_qp").rowsBetween(Window.unboundedPreceding, -1)
    w_all = Window.partitionBy(*groups) if groups else Window.partitionBy(F.lit(0))
    part = part.select("_qp", *groups, F.coalesce(F.sum("_qc").over(w_prev), F.lit(0)).alias("_qb"),
                       F.sum("_qc").over(w_all).alias("_n"))
    inside = Window.partitionBy("_qp", *groups).orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    local = s.withColumn("_ql", F.coalesce(F.sum("_c").over(inside), F.lit(0)))
    # (partition, group) pairs <= partitions + groups: small, size-checked join.
    return local.join(part, ["_qp", *groups]).select(*groups, "_v", "_c", (F.col("_qb") + F.col("_ql")).alias("_rank"), "_n")


#: Relative rank error of the sketch is 1 / ACCURACY; a bracket takes this many of it to either side.
ACCURACY, MARGIN = 10_000, 2
#: Values that a bracket may hold to be counted one by one.
MOST_INSIDE = 1 << 17


def _rank(q: float, rule: str, n: Column) -> list[Column]:
    """The wanted 0-based rank of ``n`` values, and the one above it for interpolation."""
    last, nd = n - 1, n.cast("double")
    if rule == "linear":
        h = F.lit(q) * (nd - 1)
        return [F.floor(h).cast("bigint"), F.least(last, F.ceil(h).cast("bigint"))]
    if rule == "nearest":
        return [F.least(last, F.floor(F.lit(q) * (nd - 1) + 0.5).cast("bigint"))]
    if rule == "floor_n":
        return [F.least(last, F.floor(F.lit(q) * nd).cast("bigint"))]
    raise ValueError(rule)


def _values(df: DataFrame, groups: list[str], value: str) -> DataFrame:
    """``(groups..., _v)``: the non-null, non-NaN values that have a group."""
    v = F.col(value)
    keep = v.isNotNull() & ~F.isnan(v.cast("double"))
    for g in groups:
        keep = keep & F.col(g).isNotNull()
    return df.where(keep).select(*groups, (v.cast("double") + F.lit(0.0)).alias("_v"))


def order_stats(df: DataFrame, groups: list[str], value: str, qs: dict[str, tuple[float, str]],
                n_partitions: int | None = None, accuracy: int = ACCURACY, most_inside: int = MOST_INSIDE) -> DataFrame:
    """Exact quantiles per group: one row per group with a column per name in
    ``qs`` (``{name: (q, rule)}``) plus ``n``.  By brackets (see the module)."""
    plain = [f"_g{i}" for i in range(len(groups))] or ["_g0"]  # the groups' own names may be anything
    named, groups = groups, plain
    df = df.select(*([F.col(quoted(c)).alias(g) for c, g in zip(named, plain)] or [F.lit(0).alias("_g0")]), F.col(quoted(value)).alias("_value"))
    value = "_value"
    rows = _values(df, groups, value)
    sites = [(name, j) for name, (q, rule) in qs.items() for j in range(2 if rule == "linear" else 1)]
    share = MARGIN / accuracy

    def sketch(x, shares):
        return F.percentile_approx(x, F.array(*[F.lit(min(1.0, max(0.0, s))) for s in shares]), accuracy)

    cuts = sorted({c for q, _ in qs.values() for c in (q - share, q + share)})
    first = rows.groupBy(*groups).agg(F.count(F.lit(1)).alias("n"), sketch(F.col("_v"), cuts).alias("_p"))
    # per wanted rank: its bracket; a rank near an end takes the end
    brackets = first.select(*groups, "n", *[F.struct(
        _rank(*qs[name], F.col("n"))[j].alias("k"),
        F.when(F.lit(qs[name][0] - share) > 0, F.col("_p")[cuts.index(qs[name][0] - share)]).otherwise(F.lit(float("-inf"))).alias("lo"),
        F.when(F.lit(qs[name][0] + share) < 1, F.col("_p")[cuts.index(qs[name][0] + share)]).otherwise(F.lit(float("inf"))).alias("hi"),
    ).alias(f"_b{i}") for i, (name, j) in enumerate(sites)])
    brackets = pinned(brackets)
    largest = brackets.agg(F.max("n")).first()[0] or 0
    inside = largest * 2 * share + 1  # what the first sketch leaves

    def met():
        return rows.join(brackets, groups)  # one row a group: Spark broadcasts it if its size allows

    while inside > most_inside:
        x = F.col("_v")
        aggs = []
        for i, _ in enumerate(sites):
            b = F.col(f"_b{i}")
            here = (x >= b["lo"]) & (x <= b["hi"])
            at = F.when(here, x)
            aggs += [F.count_if(x < b["lo"]).alias(f"_l{i}"), F.count_if(here).alias(f"_i{i}"),
                     F.percentile_approx(at, F.array(*[F.lit(c / 64) for c in range(65)]), accuracy).alias(f"_p{i}"), F.first(b).alias(f"_b{i}")]
        counted = met().groupBy(*groups).agg(F.max("n").alias("n"), *aggs)
        narrowed, held = [], []
        for i, _ in enumerate(sites):
            b, p, m = F.col(f"_b{i}"), F.col(f"_p{i}"), F.col(f"_i{i}")
            # the sketch's sixty-fourths around the rank, one more to either side for its error
            slot = F.floor((b["k"] - F.col(f"_l{i}")) * 64 / F.greatest(m, F.lit(1))).cast("int")
            ok = (b["k"] >= F.col(f"_l{i}")) & (b["k"] < F.col(f"_l{i}") + m)
            lo = F.when(slot >= 2, F.get(p, slot - 1)).otherwise(b["lo"])
            hi = F.when(slot <= 61, F.get(p, slot + 2)).otherwise(b["hi"])
            narrowed.append(F.struct(b["k"].alias("k"), F.when(ok, lo).otherwise(b["lo"]).alias("lo"), F.when(ok, hi).otherwise(b["hi"]).alias("hi")).alias(f"_b{i}"))
            held.append(F.when(ok & (b["lo"] < b["hi"]), m).otherwise(F.lit(0)))
        counted = pinned(counted.select(*groups, "n", *narrowed, F.greatest(*held, F.lit(0)).alias("_held")))
        brackets, before = counted.drop("_held"), inside
        inside = (counted.agg(F.max("_held")).first()[0] or 0) * (3 / 64 + 2 * share) + 1
        if inside >= before:  # few values, each of them frequent: counting them one by one is small
            break
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("w"), F.col(f"_b{i}").alias("b")) for i in range(len(sites))]))
    cells = met().select(*groups, "n", "_v", each.alias("_e")).where(F.col("_v") <= F.col("_e.b.hi"))
    below = F.col("_v") < F.col("_e.b.lo")
    counts = (cells.select(*groups, "n", F.col("_e.w").alias("_w"), F.col("_e.b.k").alias("_k"), F.when(~below, F.col("_v")).alias("_v"))
              .groupBy(*groups, "n", "_w", "_k", "_v").agg(F.count(F.lit(1)).alias("_c")))
    inside_w = Window.partitionBy(*groups, "_w").orderBy(F.col("_v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    ranked_ = counts.withColumn("_r", F.coalesce(F.sum("_c").over(inside_w), F.lit(0)))
    hit = ranked_.where(F.col("_v").isNotNull() & (F.col("_r") <= F.col("_k")) & (F.col("_k") < F.col("_r") + F.col("_c")))
    found = pinned(hit.groupBy(*groups).agg(F.max("n").alias("n"), *[F.max(F.when(F.col("_w") == i, F.col("_v"))).alias(f"_x{i}") for i in range(len(sites))]))
    complete = F.lit(True)
    for i in range(len(sites)):
        complete = complete & F.col(f"_x{i}").isNotNull()
    names = [F.col(g).alias(c) for g, c in zip(plain, named)]
    if found.where(complete).count() < brackets.count():  # a sketch beyond its error
        return order_stats_of(value_counts(df, groups, value), groups, qs, n_partitions).select(*names, "n", *qs)
    out = [*names, "n"]
    for name, (q, rule) in qs.items():
        x = [F.col(f"_x{i}") for i, (s, _) in enumerate(sites) if s == name]
        if rule == "linear":
            h = F.lit(q) * (F.col("n").cast("double") - 1)
            out.append((x[0] + (x[1] - x[0]) * (h - F.floor(h))).alias(name))
        else:
            out.append(x[0].alias(name))
    return found.select(*out)


def order_stats_of(counts: DataFrame, groups: list[str], qs: dict[str, tuple[float, str]],
                   n_partitions: int | None = None) -> DataFrame:
    """``order_stats`` from counted values (groups, ``_v``, ``_c``).  Ranks are
    derived on the executors from each group's size, without a driver round trip."""
    r = ranked(counts, groups, n_partitions)
    nd = F.col("_n").cast("double")
    last = F.col("_n") - 1
    aggs, wanted = [], F.lit(False)

    def at(k):  # the value whose copies hold rank k
        return (F.col("_rank") <= k) & (k < F.col("_rank") + F.col("_c"))

    for name, (q, rule) in qs.items():
        if rule == "linear":
            h = F.lit(q) * (nd - 1)
            lo, hi = F.floor(h).cast("bigint"), F.least(last, F.ceil(h).cast("bigint"))
            aggs += [F.max(F.when(at(lo), F.col("_v"))).alias(f"{name}__lo"), F.max(F.when(at(hi), F.col("_v"))).alias(f"{name}__hi"),
                     F.max(h - F.floor(h)).alias(f"{name}__fr")]
            wanted = wanted | at(lo) | at(hi)
            continue
        if rule == "nearest":
            k = F.least(last, F.floor(F.lit(q) * (nd - 1) + 0.5).cast("bigint"))
        elif rule == "floor_n":
            k = F.least(last, F.floor(F.lit(q) * nd).cast("bigint"))
        else:
            raise ValueError(rule)
        aggs.append(F.max(F.when(at(k), F.col("_v"))).alias(name))
        wanted = wanted | at(k)
    # keep only the values that hold a wanted rank before aggregating: the filter runs map-side
    g = r.where(wanted).groupBy(*groups) if groups else r.where(wanted).groupBy()
    res = g.agg(F.max("_n").alias("n"), *aggs)
    out = [*groups, "n"]
    for name, (q, rule) in qs.items():
        if rule == "linear":
            lo, hi, fr = F.col(f"{name}__lo"), F.col(f"{name}__hi"), F.col(f"{name}__fr")
            out.append((lo + (hi - lo) * fr).alias(name))
        else:
            out.append(name)
    return res.select(*out)
