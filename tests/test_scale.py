"""Operators that bound what they shuffle or hand to one task: exactness and plans."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablecare.functions import predicates as P
from tablecare.operators import fill, profile as prof, quantiles
from tablecare.operators.analysis import Analysis
from tablecare.operators.classify import DATE_SHAPE, date_counts
from tablecare.operators.clean import DATE_FORMATS, clean, unify_dates
from tablecare.operators.table import hash_sample
from tablecare.plans import scale_queries
from tablecare.plans.profile_store import ProfileStore, files_under
from tablecare.session import pinned, scratch_path

from test_plan_shapes import plan_of

SF = "/root/testdata/sf0.001"


# ------------------------------------------------------------------- modes ---
def test_modes_of_hot_flat_and_odd_columns(spark):
    rnd = random.Random(1)
    rows = [(f"hot value {0 if rnd.random() < .4 else i}", float(i), f"t{i}", rnd.choice([None, " ", "n/a", "NULL"]), rnd.choice([1, 2, 2, 3]),
             float("nan") if i % 2 else -0.0) for i in range(30_000)]
    df = spark.createDataFrame(rows, "hot string, `all distinct` double, `text.flat` string, none string, small int, nan double")
    got = prof.modes(df, df.columns)
    assert got["hot"][0] == "hot value 0" and got["hot"][2] > 10_000
    assert got["all distinct"] == (None, 0.0, 1) and got["text.flat"] == ("t0", None, 1)
    assert got["none"] == (None, None, 0) and got["small"][:2] == (None, 2.0) and got["nan"] == (None, 0.0, 15_000)
    one = spark.createDataFrame([("b",), ("a",), ("b",), ("a",)], "x string")
    assert prof.modes(one, ["x"]) == {"x": ("a", None, 2)}
    assert prof.modes(one.limit(0), ["x"]) == {"x": (None, None, 0)}


def test_a_mode_counts_candidates_only(spark, monkeypatch):
    """No count of every (column, value) where a frequent value exists."""
    monkeypatch.setattr(prof, "value_counts_long", lambda *a: pytest.fail("all values counted"))
    df = spark.range(0, 50_000).select(F.when(F.col("id") % 3 > 0, F.lit("often")).when(F.col("id") % 100 > 0, F.col("id").cast("string")).alias("s"))
    a = Analysis(df)
    out = clean(a, "Missing Values", ["s"], "Fill with Mode")
    assert out.where("s IS NULL").count() == 0 and out.where("s = 'often'").count() > 33_000
    assert not a._distinct.counted and "_quantiles" not in a.__dict__


# --------------------------------------------------------------- quantiles ---
@pytest.mark.parametrize("accuracy,inside", [(10_000, 1 << 17), (50, 100), (20, 1), (200, 30)])
def test_brackets_are_exact(spark, accuracy, inside):
    rng = np.random.default_rng(accuracy)
    data = {0: rng.normal(size=4000), 1: rng.integers(0, 5, 3000).astype(float), 2: np.full(500, 7.0), 3: np.array([3.0]),
            4: np.concatenate([np.zeros(2500), rng.normal(size=800)]), 5: np.exp(rng.normal(size=2000) * 5)}
    rows = [(g, float(v)) for g, x in data.items() for v in x] + [(None, 1.0), (0, None), (0, float("nan"))]
    df = spark.createDataFrame(rows, "g int, x double").repartition(5)
    qs = {"p0": (0.0, "nearest"), "a": (0.1, "nearest"), "m": (0.5, "linear"), "f": (0.75, "floor_n"), "p100": (1.0, "floor_n")}
    got = {r.g: r for r in quantiles.order_stats(df, ["g"], "x", qs, accuracy=accuracy, most_inside=inside).collect()}
    assert set(got) == set(data)
    for g, x in data.items():
        s, n = np.sort(x), len(x)
        r = got[g]
        assert r.n == n and (r.p0, r.p100) == (s[0], s[-1])
        assert r.a == s[int(np.floor(0.1 * (n - 1) + 0.5))] and r.f == s[min(n - 1, int(0.75 * n))]
        assert r.m == pytest.approx(np.median(x))


def test_brackets_of_nothing(spark):
    empty = spark.createDataFrame([], "g int, x double")
    assert quantiles.order_stats(empty, ["g"], "x", {"m": (0.5, "linear")}).collect() == []


def test_what_quantiles_shuffle_does_not_grow(spark, monkeypatch):
    """The last count sees the values inside the brackets only."""
    seen = []
    real = quantiles.pinned
    monkeypatch.setattr(quantiles, "pinned", lambda df: seen.append(df) or real(df))
    df = spark.range(0, 200_000).select((F.col("id") % 2).alias("g"), F.rand(3).alias("x"))
    quantiles.order_stats(df, ["g"], "x", {"m": (0.5, "nearest")}, accuracy=1000, most_inside=2000).collect()
    plan = plan_of(seen[-1])
    assert "rangepartitioning" not in plan and "_e" in plan
    lo, hi = (np.array([r[0] for r in seen[-2].select(f"_b0.{k}").collect()]) for k in ("lo", "hi"))
    assert (hi - lo < 0.01).all()  # of 100,000 values a group, less than a thousand are counted


# ------------------------------------------------------------------- fills ---
@pytest.mark.parametrize("way", ["forward", "backward"])
def test_carries_over_levels(spark, way):
    rnd = random.Random(way)
    rows = [(i, i if rnd.random() < .02 else None) for i in range(3000) if rnd.random() < .9]
    df = spark.createDataFrame(rows, "i long, v long").repartition(4)
    got = {r.i: r.near for r in fill.nearest_values(df, {"near": F.col("v")}, way, "i", block=5, fan=4, levels=5).collect()}
    last, want = None, {}
    for i, v in (rows if way == "forward" else rows[::-1]):
        last = v if v is not None else last
        want[i] = last
    assert got == want


def test_no_window_over_all_blocks(spark):
    df = spark.range(0, 1000).select(F.col("id").alias("_row_id"), F.when(F.col("id") % 7 == 0, F.col("id")).alias("v"))
    assert "SinglePartition" not in plan_of(fill.nearest_values(df, {"near": F.col("v")}, block=10))


# ------------------------------------------------------------------- dates ---
def test_shape_lets_every_date_through(spark):
    rnd = random.Random(5)
    stamps = spark.range(0, 400).select(F.timestamp_seconds(F.col("id") * 7_654_321).alias("t"))
    for f in DATE_FORMATS:
        texts = stamps.select(F.date_format("t", f).alias("s")).withColumn("ok", unify_dates(F.col("s")).isNotNull())
        assert texts.where(F.col("ok") & ~F.col("s").rlike(DATE_SHAPE)).count() == 0 and texts.where("ok").count() == 400
    parts = ["2023", "12023", "01", "1", "13", "-", "/", ".", " ", ", ", "Jan", "May", "x", "T", "10:11:12", "+"]
    odd = spark.createDataFrame([("".join(rnd.choice(parts) for _ in range(rnd.randint(1, 6))),) for _ in range(20_000)], "s string")
    assert odd.where(unify_dates(P.strip_ws("s")).isNotNull() & ~P.strip_ws("s").rlike(DATE_SHAPE)).count() == 0


def test_date_counts_and_on_demand(spark):
    df = spark.createDataFrame([(" 2023-01-02 ", "2023"), ("2023-01-02", "20230102"), ("x", None), (None, "May 1, 2023")], "`a.b` string, c string")
    assert {r["column"]: r["dates"] for r in date_counts(df, ["a.b", "c"]).collect()} == {"a.b": 2, "c": 2}
    a = Analysis(df)
    assert {r["column"]: r["date_share"] for r in a.date_shares.collect()} == {"a.b": 2 / 3, "c": 2 / 3}
    b = Analysis(spark.range(0, 100).select(F.when(F.col("id") % 7 > 0, F.col("id").cast("double")).alias("x"), F.lit("2023-01-01").alias("s")))
    clean(b, "Missing Values", ["x"], "Fill with Mean").count()
    assert "date_shares" not in b.__dict__


def test_spellings_need_no_other_column(spark, monkeypatch):
    df = spark.createDataFrame([("Apple", 1.0)] * 3 + [("apple", 2.0), ("Pear", 3.0), (" ", 4.0), (None, 5.0)], "`k.d` string, x double")
    a = Analysis(df)
    assert a._category_columns == ["k.d"] and not a._distinct.counted
    flags = [r._inconsistent_category_cols for r in a.flag_frame().where("`k.d` = 'apple'").collect()]
    assert flags == [["k.d"]] or flags == ["k.d"]


# ----------------------------------------------------------------- pinning ---
def test_pinned_rows_keep_names_and_types(spark):
    df = spark.range(0, 10).select(F.col("id").alias("a.b"), F.lit("x").alias("with space"), F.array(F.col("id")).alias("c`d"), F.lit(None).alias("v"))
    for d in (df, df.drop("v")):
        p = pinned(d)
        assert p.columns == d.columns and p.count() == 10
    assert "ReadSchema: struct<c0:bigint>" in plan_of(pinned(df.drop("v")).select("`a.b`"))


# --------------------------------------------------------- profile by file ---
def test_changed_files_cost_only_themselves(spark):
    base, reads = scratch_path(spark, "t"), []

    def read(files):
        reads.append(sorted(files))
        return spark.read.parquet(*files)

    store = ProfileStore(spark, scratch_path(spark, "s"), read)
    rows = spark.range(0, 5000).select(F.col("id"), F.when(F.col("id") % 5 > 0, F.rand(1) * 100).alias("x"), (F.col("id") % 7).cast("string").alias("t"))
    for k in range(4):
        rows.where(F.col("id") % 4 == k).coalesce(1).write.parquet(f"{base}/{k}")
    files = files_under(spark, base)
    assert len(files) == 4

    def check(files):
        got = {r["column"]: r for r in store.profile(files).collect()}
        want = {r["column"]: r for r in prof.profile(spark.read.parquet(*[f for f, _, _ in files]), with_quantiles=False).collect()}
        for c, w in want.items():
            for k in ("rows", "nulls", "missing", "empty", "valid", "n", "min", "max"):
                assert got[c][k] == w[k], (c, k)
            for k in ("mean", "std", "sum", "skew"):
                assert got[c][k] == (None if w[k] is None else pytest.approx(w[k], rel=1e-9, abs=1e-9)), (c, k)
            assert got[c]["distinct_approx"] == pytest.approx(w["distinct_nonnull"], rel=0.05)
        return got

    got = check(files)
    assert got["x"].median_approx == pytest.approx(50, abs=4)
    assert reads == [[f for f, _, _ in files]]
    check(files[1:])  # a dropped file is not read, nor are the others
    assert len(reads) == 1
    rows.where("id % 4 = 2 AND x < 50").coalesce(1).write.mode("overwrite").parquet(f"{base}/2")
    now = files_under(spark, base)
    check(now)
    assert len(reads) == 2 and reads[1] == [f for f, _, _ in now if "/2/" in f]
    rows.where("id < 0").coalesce(1).write.parquet(f"{base}/empty")
    check(files_under(spark, base))
    check(files_under(spark, base))
    assert len(reads) == 3


# ----------------------------------------------------------------- samples ---
def test_equal_rows_are_drawn_one_by_one(spark):
    df = spark.range(0, 2000).select(F.when(F.col("id") % 10 < 3, F.lit(-1)).otherwise(F.col("id")).alias("v"))
    for seed in range(4):
        n = hash_sample(df, 200, seed).where("v = -1").count()
        assert 35 < n < 90
    assert hash_sample(df, 10).columns == ["v"]


def test_registered_rows_are_not_empty(spark):
    for name in scale_queries.QUERIES:
        assert scale_queries.QUERIES[name][0](spark, SF).count() > 0


# ------------------------------------------------------------------- pages ---
def test_pages_of_a_sorted_table(spark):
    from tablecare.operators.paging import SortedPages
    rnd = random.Random(3)
    rows = [(i, rnd.choice([None, 1.0, 2.0, rnd.random()]), f"t{i}") for i in range(2300)]
    df = spark.createDataFrame(rows, "id long, `unit.price` double, t string").repartition(6)
    for desc in (False, True):
        pages = SortedPages(df, "unit.price", desc, ["id"], rows_per_range=200)
        want = sorted(rows, key=lambda r: (r[1] is not None, (-r[1] if desc else r[1]) if r[1] is not None else 0, r[0]))
        assert pages.rows == 2300 and pages.total_pages(70) == 33 and len(pages.directory()) > 5
        for no in (1, 2, 5, 17, 32, 33, 34):
            assert [tuple(r) for r in pages.page(no, 70).collect()] == want[(no - 1) * 70:no * 70]
        assert len(pages.page(1, 0).collect()) == 2300
    held = max(b - a for _, a, b in pages.directory())
    plan = plan_of(pages.page(17, 70))
    assert held < 1200 and "PushedFilters" in plan and "_place" in plan and "CollectLimit" not in plan
    assert SortedPages(df.limit(0), "unit.price", tie=["id"]).page(1).collect() == []


def test_a_task_of_a_fill_does_not_grow_with_the_table(spark, monkeypatch):
    from tablecare.operators import fill as L
    monkeypatch.setattr(L, "TASK_ROWS", 40)
    rows = [(i, None if i % 5 else float(i * i % 97), None if i % 3 or i < 30 else float(i)) for i in range(1, 2000)]
    df = spark.createDataFrame(rows, "_row_id long, a double, b double").repartition(3)
    out = L.fill(df, {c: F.col(c).isNull() for c in "ab"}, {c: F.col(c).isNotNull() for c in "ab"}, "linear", block=16)
    plan = plan_of(out)
    assert "hashpartitioning(_blk" in plan and ", 50), REPARTITION_BY_NUM" in plan
    assert out.rdd.getNumPartitions() == 50  # it was the session's number, whatever the rows
    known = {c: [(r[0], r[k]) for r in rows if r[k] is not None] for k, c in ((1, "a"), (2, "b"))}
    for r in out.collect():
        for c in "ab":
            p, n = [x for x in known[c] if x[0] <= r["_row_id"]][-1:], [x for x in known[c] if x[0] >= r["_row_id"]][:1]
            want = None if not (p and n) else p[0][1] if p == n else p[0][1] + (n[0][1] - p[0][1]) * (r["_row_id"] - p[0][0]) / (n[0][0] - p[0][0])
            assert r[c] == pytest.approx(want)


def test_small_ranges_share_a_task(spark):
    from tablecare.operators.paging import SortedPages
    pages = SortedPages(spark.range(3000).selectExpr("id", "id % 7 AS k").repartition(4), "k", tie=["id"], rows_per_range=10)
    assert pages._stored.rdd.getNumPartitions() <= 8 and len(pages._stored.inputFiles()) == 1  # it was a task and file a range
    assert pages.directory() == [(i, i * 10, i * 10 + 10) for i in range(300)]
    assert [r.id for r in pages.page(100, 30).collect()] == sorted(range(3000), key=lambda i: (i % 7, i))[2970:]


def test_pages_over_several_parts(spark, monkeypatch):
    from tablecare.operators import paging
    monkeypatch.setattr(paging, "PART_ROWS", 100)
    pages = paging.SortedPages(spark.range(1000).selectExpr("id", "999 - id AS k").repartition(4), "k", tie=["id"], rows_per_range=7)
    assert len(pages._parts) > 5 and max(b - a for _, a, b in pages.directory()) == 7
    for no, limit in ((1, 1000), (1, 0), (2, 450), (3, 333), (4, 333), (2, 1000), (17, 3)):
        at = (no - 1) * limit
        assert [r.k for r in pages.page(no, limit).collect()] == list(range(1000))[at:at + limit if limit else None]


def test_deep_table_page_is_the_same(spark):
    from tablecare.operators.rowid import with_row_id
    from tablecare.plans.quality import sorted_pages, table_page
    df = with_row_id(spark.range(0, 400).select((F.col("id") % 50).alias("k"), F.lit("text").alias("s")), ["k"])
    a = Analysis(df)
    pages = sorted_pages(a, "TEXT", "k", True, rows_per_range=60)
    one, two = (table_page(a, "TEXT", "k", True, 15, 20, pages=p)[0].collect() for p in (None, pages))
    assert one == two and len(one) == 20


# ---------------------------------------------------------------- versions ---
def test_a_kept_version_runs_no_step_again(spark, monkeypatch):
    from tablecare.plans import recipe as R
    ran = []
    real = R.Recipe.step
    monkeypatch.setattr(R.Recipe, "step", lambda self, df, i: ran.append(i) or real(self, df, i))
    path = scratch_path(spark, "src")
    spark.createDataFrame([(i, None if i % 3 else float(i), " a ") for i in range(30)], "id long, `x.y` double, t string").write.parquet(path)
    src = spark.read.parquet(path)
    recipe = R.Recipe(order_by=["id"]).then(R.Step("Missing Values", "Fill with Mean", ("x.y",))).then(R.Step("Extra Spaces", "Trim Spaces", ("t",)))
    store = R.VersionStore(spark, scratch_path(spark, "kept"))
    whole = sorted(store.version(recipe, src).collect())
    assert ran == [0, 1] and whole == sorted(recipe.apply(src).collect())
    ran.clear()
    assert sorted(store.version(recipe, src).collect()) == whole and store.version(recipe, src, 1).where("t = ' a '").count() == 30
    longer = recipe.then(R.Step("Missing Values", "Drop Column", ("x.y",)))
    assert store.version(longer, src).columns == ["id", "t"] and ran == [2]
    assert store.version(recipe, src, 0).count() == 30 and store.has(recipe, src, 2)
    spark.createDataFrame([(1, 2.0, "b")], "id long, `x.y` double, t string").write.mode("overwrite").parquet(path)
    ran.clear()
    assert store.version(recipe, spark.read.parquet(path)).count() == 1 and ran == [0, 1]  # the source has changed


# -------------------------------------------------------------------- cube ---
def test_cube_answers_filters_without_the_table(spark):
    from tablecare.operators import dashboard as D
    rnd = random.Random(4)
    rows = [(rnd.choice(["a", "b", None]), rnd.choice(["x", "y"]), float(i % 17) if i % 5 else None, i % 9, f"w{i % 300}") for i in range(3000)]
    df = spark.createDataFrame(rows, "`kind.of` string, side string, v double, n int, wide string")
    classes = {"kind.of": "Categorical_LowCard", "side": "Categorical_LowCard", "v": "Numeric", "n": "Numeric", "wide": "Categorical_HighCard"}
    cube = D.cube_of(df, classes)
    for filters in ({}, {"side": ["x"]}, {"kind.of": ["a", "b"], "side": ["y"]}, {"kind.of": [], "side": ["x"]}):
        assert cube.holds(["wide"], filters)
        a, b = D.filtered_dashboard(df, filters, classes, cube=cube), D.filtered_dashboard(df, filters, classes)
        assert sorted(a["kpis"].collect()) == sorted(b["kpis"].collect())
        for (kind, title, x), (kind2, title2, y) in zip(a["charts"], b["charts"]):
            assert (kind, title) == (kind2, title2) and x.columns == y.columns
            if kind != "scatter":
                assert sorted(x.collect(), key=str) == sorted(y.collect(), key=str), title
    assert not cube.holds(["side"], {"v": {"min": 1}}) and not cube.holds(["side"], {"wide": ["w1"], "n": [1]})
    for c in ("counts", "sums"):
        plan = plan_of(cube.counts("side", {"kind.of": ["a"]}) if c == "counts" else cube.sums(["side"], "v"))
        assert plan.count("Scan parquet") == 1 and "LocalTableScan" not in plan
    small = D.ChartCube(df, classes, {"kind.of": 4, "side": 2, "wide": 300}, most_rows=8)
    assert small.dims == ["kind.of"] and not small.holds(["side"]) and small.holds(["wide"])
    assert sorted(small.counts("wide").collect()) == sorted(df.groupBy("wide").count().collect())
