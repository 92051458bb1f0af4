"""Chart planner (J12): candidate charts from the profile, each with its
relevance score and its aggregate DataFrame; sorted by relevance, capped.

Scores (fixed values): heatmap 95, scatter 70 + 30|r|, histogram 85, category
80, trend 80 + min(20, 50 cv), crosstab 75, mean bar 75 + min(25, 20|cv|),
all capped at 100.  Charts aggregate the whole table; only scatter points are
a deterministic sample.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import predicates as P
from ..functions.predicates import quoted as q
from ..operators import charts as C
from ..operators.classify import planner_id_columns
from ..operators.profile import profile

# The scores named above, and the least correlation and variation that make a chart.
HEATMAP, HISTOGRAM, CATEGORY, CROSSTAB = 95, 85, 80, 75
LEAST_R, LEAST_CV = 0.15, 0.05


def plan_charts(df: DataFrame, max_charts: int | None = None, max_heat: int | None = None) -> list[dict]:
    """Every candidate chart of an active column, most relevant first; a caller
    may limit the charts and the heatmap's columns."""
    prof = profile(df, with_quantiles=False)
    ids = {r["column"] for r in planner_id_columns(prof).collect()}
    st = {r["column"]: r for r in prof.collect()}
    types = {f.name: f.dataType for f in df.schema.fields}
    cols = [c for c in df.columns if c not in ids]
    nums = [c for c in cols if P.is_numeric(types[c]) and not P.is_string(types[c])]
    cats = [c for c in cols if P.is_string(types[c]) or str(types[c]) == "BooleanType()"]
    dates = [c for c in cols if P.is_date(types[c])]
    plans: list[dict] = []
    if len(nums) >= 2:
        heat = nums[:max_heat]
        corr = C.corr_matrix(df, heat, 2)
        plans.append({"type": "heatmap", "x": "ALL_NUMERICAL", "y": "ALL_NUMERICAL", "score": HEATMAP, "data": corr})
        # one row for each pair of columns
        pairs = [(r["x"], r["y"], r["r"]) for r in corr.collect()
                 if heat.index(r["x"]) < heat.index(r["y"]) and abs(r["r"]) >= LEAST_R]
        for x, y, r in pairs:
            plans.append({"type": "scatter", "x": x, "y": y, "score": int(70 + abs(r) * 30),
                          "data": C.scatter_sample(df, x, y, 2000)})
    for c in nums:
        if (st[c]["n"] or 0) > 0:
            plans.append({"type": "histogram", "x": c, "y": "count", "score": HISTOGRAM, "data": C.histogram(df, c, 20, "right")})
    valid = [c for c in cats if 1 < (st[c]["distinct_nonnull"] or 0) <= 50]
    for i, c in enumerate(valid):
        kind = ("pie" if i % 2 == 0 else "donut") if st[c]["distinct_nonnull"] <= 6 else "bar"
        plans.append({"type": kind, "x": c, "y": "count", "score": CATEGORY, "data": C.value_counts(df.where(F.col(q(c)).isNotNull()), c, 20)})
    spark = df.sparkSession
    for d in dates:
        if not nums:
            break
        # one aggregate per date column: monthly means of every numeric column
        dd = df.where(F.col(q(d)).isNotNull())
        means = dd.groupBy(F.last_day(F.to_date(q(d))).alias("month")).agg(
            *[F.avg(q(y)).alias(f"_m{i}") for i, y in enumerate(nums)])
        monthly = C.month_spine(dd, d).join(means, "month", "left")
        small = spark.createDataFrame(monthly.collect(), monthly.schema)   # one row per month
        for i, y in enumerate(nums):
            m = small.select("month", F.col(f"_m{i}").alias(y))
            t = C.trend_summary(m, y).first()
            if t is None or not t["keep"]:
                continue
            plans.append({"type": "area" if i % 2 == 0 else "line", "x": d, "y": y,
                          "score": int(80 + min(20, (t["cv"] or 0) * 50)), "data": C.monthly_mean(df, d, y)})
    for i in range(len(valid)):
        for j in range(i + 1, len(valid)):
            x, y = valid[i], valid[j]
            if st[y]["distinct_nonnull"] <= 10 and st[x]["distinct_nonnull"] <= 15:
                plans.append({"type": "stacked_bar" if (i + j) % 2 == 0 else "grouped_bar", "x": x, "y": y,
                              "score": CROSSTAB, "data": C.crosstab(df, x, y, 15)})
    for x in valid:
        if st[x]["distinct_nonnull"] > 20 or not nums:
            continue
        # one aggregate per category column: group means of every numeric column
        g = df.where(F.col(q(x)).isNotNull()).groupBy(q(x)).agg(*[F.avg(q(y)).alias(f"_m{i}") for i, y in enumerate(nums)])
        groups = g.collect()                                               # <= 20 groups
        for i, y in enumerate(nums):
            top = sorted(((r[x], r[f"_m{i}"]) for r in groups if r[f"_m{i}"] is not None),
                         key=lambda t: (-t[1], t[0]))[:20]
            vals = [v for _, v in top]
            if len(vals) < 2:
                continue
            mu = sum(vals) / len(vals)
            sd = (sum((v - mu) ** 2 for v in vals) / (len(vals) - 1)) ** 0.5
            cv = sd / mu if mu != 0 else 0.0
            if abs(cv) <= LEAST_CV:
                continue
            plans.append({"type": "bar", "x": x, "y": y, "score": int(75 + min(25, abs(cv) * 20)),
                          "data": C.mean_by(df, x, y, 20, 0.05).drop("cv")})
    for p in plans:
        p["score"] = min(100, p["score"])
    plans.sort(key=lambda p: -p["score"])
    return plans[:max_charts]


def plan_table(plans: list[dict], spark) -> DataFrame:
    """The plan itself as a DataFrame ``(rank, type, x, y, score)``; a plan
    without charts is one row of type ``none``."""
    plans = plans or [{"type": "none", "x": None, "y": None, "score": 0}]
    rows = [(i + 1, p["type"], p["x"], p["y"], int(p["score"])) for i, p in enumerate(plans)]
    return spark.createDataFrame(rows, "rank int, type string, x string, y string, score int")
