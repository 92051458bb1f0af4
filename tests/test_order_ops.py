"""Row ids, blocked fills and exact order statistics equal their
single-partition definitions (checked on data split across many blocks)."""

import random

import numpy as np
from pyspark.sql import Window, functions as F

from tablecare.operators.fill import fill
from tablecare.operators.quantiles import order_stats
from tablecare.operators.rowid import with_row_id


def test_row_id_consecutive(spark):
    rnd = random.Random(1)
    rows = [(rnd.randint(0, 10**6), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "k long, j long").repartition(7)
    x = with_row_id(df, ["k", "j"], n_partitions=5)
    chk = x.withColumn("rn", F.row_number().over(Window.orderBy("k", "j")) - 1)
    assert chk.where("rn != _row_id").count() == 0
    y = with_row_id(df)
    ids = sorted(r._row_id for r in y.select("_row_id").collect())
    assert ids == list(range(3000))


def _window_ref(df, c, direction):
    if direction == "forward":
        w = Window.orderBy("_row_id").rowsBetween(Window.unboundedPreceding, 0)
        return F.last(F.col(c), ignorenulls=True).over(w)
    w = Window.orderBy("_row_id").rowsBetween(0, Window.unboundedFollowing)
    return F.first(F.col(c), ignorenulls=True).over(w)


def test_blocked_fill_matches_window(spark):
    rnd = random.Random(7)
    rows = [(i, None if rnd.random() < 0.6 else float(rnd.randint(0, 100))) for i in range(2000)]
    rows[:30] = [(i, None) for i in range(30)]
    df = spark.createDataFrame(rows, "_row_id long, v double")
    tgt = {"v": F.col("v").isNull()}
    use = {"v": F.col("v").isNotNull()}
    for method, direction in (("previous", "forward"), ("next", "backward")):
        got = fill(df, tgt, use, method, block=64).select("_row_id", F.col("v").alias("g"))
        ref = df.select("_row_id", _window_ref(df, "v", direction).alias("r"))
        bad = got.join(ref, "_row_id").where(~F.col("g").eqNullSafe(F.col("r"))).count()
        assert bad == 0, method
    got = {r._row_id: r.v for r in fill(df, tgt, use, "linear", block=64).collect()}
    known = [(i, v) for i, v in rows if v is not None]
    xs, ys = [i for i, _ in known], [v for _, v in known]
    for i, v in rows:
        if v is None and xs[0] < i < xs[-1]:
            assert abs(got[i] - float(np.interp(i, xs, ys))) < 1e-9
        elif v is None:
            assert got[i] is None


def test_order_stats_exact_with_hot_group(spark):
    rnd = random.Random(3)
    rows = [("hot", float(rnd.randint(0, 500))) for _ in range(3000)]
    rows += [(g, float(rnd.randint(0, 50))) for g in ("a", "b", "c") for _ in range(rnd.randint(1, 40))]
    df = spark.createDataFrame(rows, "g string, v double")
    qs = {"q1": (0.25, "nearest"), "med": (0.5, "linear"), "q3b": (0.75, "floor_n")}
    got = {r.g: r for r in order_stats(df, ["g"], "v", qs, n_partitions=6).collect()}
    for g in {r[0] for r in rows}:
        vals = sorted(v for k, v in rows if k == g)
        n = len(vals)
        assert got[g].n == n
        assert got[g].q1 == vals[int(0.25 * (n - 1) + 0.5)]
        assert abs(got[g].med - float(np.quantile(vals, 0.5))) < 1e-9
        assert got[g].q3b == vals[min(n - 1, int(0.75 * n))]


def test_approx_profile_close_to_exact(spark):
    from tablecare.operators.profile import profile
    df = spark.range(0, 20000).select((F.col("id") % 997).cast("double").alias("x"),
                                      (F.col("id") % 13).cast("string").alias("s"))
    ex = {r.column: r for r in profile(df).collect()}
    ap = {r.column: r for r in profile(df, approx=True).collect()}
    assert abs(ap["x"].distinct - ex["x"].distinct) / ex["x"].distinct < 0.05
    assert ap["s"].distinct == ex["s"].distinct == 13
    for q in ("q1", "median", "q3", "p95"):
        assert abs(ap["x"][q] - ex["x"][q]) <= 997 * 0.01


def test_quantiles_equal_sorted_values(spark):
    from tablecare.operators.profile import QUANTILES, quantile_stats
    rnd = random.Random(11)
    rows = [(float(rnd.randint(0, 40)), rnd.gauss(0, 1), None if i % 7 == 0 else float(i % 13), float(i), 0.0 if i % 5 else float(i))
            for i in range(5000)]
    cols = ["ties", "g", "sparse", "seq", "mostly.zero"]
    df = spark.createDataFrame(rows, ", ".join(f"`{c}` double" for c in cols))
    got = {r.column: r for r in quantile_stats(df, cols).collect()}
    for c in cols:
        vals = sorted(v for v in (r[cols.index(c)] for r in rows) if v is not None)
        n = len(vals)
        for k, (q, rule) in QUANTILES.items():
            want = vals[int(q * (n - 1) + 0.5)] if rule == "nearest" else float(np.quantile(vals, q))
            assert abs(got[c][k] - want) < 1e-9, (c, k)


def test_hot_value_is_one_row(spark):
    """A value that fills 80 % of a column is one row to rank, so no task gets more than its share."""
    from tablecare.operators.quantiles import ranked, value_counts
    df = spark.range(0, 40000).select(F.lit("g").alias("g"), F.when(F.col("id") % 5 > 0, 0.0).otherwise(F.col("id").cast("double")).alias("v"))
    counts = value_counts(df, ["g"], "v")
    assert counts.count() == 8000
    r = ranked(counts, ["g"], n_partitions=8)
    zero = r.where("_v = 0").first()
    assert (zero._c, zero._rank, zero._n) == (32001, 0, 40000)
    sizes = [x["count"] for x in counts.repartitionByRange(8, "g", "_v").groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) <= 2 * (sum(sizes) / len(sizes))




def test_row_ids_without_keys_lose_no_rows(spark):
    """On a shuffled frame, read back after a write: every row, every id once."""
    import tempfile
    from tablecare.operators.rowid import with_row_id
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    try:
        df = spark.range(0, 20000).groupBy((F.col("id") % 20000).alias("k")).agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("pad"))
        path = tempfile.mkdtemp() + "/out"
        with_row_id(df).write.parquet(path)
        got = spark.read.parquet(path)
        assert got.count() == 20000 and got.select("k").distinct().count() == 20000
        assert got.agg(F.count_distinct("_row_id"), F.min("_row_id"), F.max("_row_id")).first() == (20000, 0, 19999)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_exact_duplicate_keys(spark):
    from decimal import Decimal
    from tablecare.operators.analysis import Analysis
    from tablecare.operators.clean import clean
    rows = [(2**53, Decimal("1.000000000000000001"), 1.0), (2**53 + 1, Decimal("1.000000000000000001"), 1.0),
            (2**53, Decimal("1.000000000000000002"), 1.0), (2**53, Decimal("1.000000000000000001"), 1.0), (None, None, 0.0), (None, None, -0.0)]
    df = spark.createDataFrame(rows, "i bigint, d decimal(38,18), f double")
    a = Analysis(df)
    assert clean(a, "Duplicate Rows", ["all"], "Keep First").count() == 4
    assert sorted(r._is_duplicate for r in a.flag_frame().collect()) == [False, False, True, True, True, True]


def test_names_with_dots(spark):
    from tablecare.operators.analysis import Analysis
    from tablecare.operators.clean import clean
    df = spark.createDataFrame([("1.5", None), ("2", " x"), ("N/A", "y"), ("3", "y")] * 5, "`unit.price` string, `a b.c` string")
    a = Analysis(df)
    assert a.flag_frame().count() == 20 and a.types["unit.price"].simpleString() == "double"
    assert clean(a, "Missing Values", ["unit.price"], "Fill with Mean").where("`unit.price` IS NULL").count() == 0
