"""Recipe, diff, re-profile, dashboard and planner checks."""

from pyspark.sql import functions as F

from tablecare.operators.analysis import Analysis
from tablecare.operators.dashboard import classes_of, kpis, slicers
from tablecare.operators.diff import changed_rows, removed_rows, step_summary
from tablecare.operators.profile import profile, reprofile
from tablecare.plans.planner import plan_charts
from tablecare.plans.quality import column_table
from tablecare.plans.recipe import Recipe, Step
from tablecare.plans.recommend import recommend_methods

ROWS = [(i, None if i % 4 == 0 else float(i), "N/A" if i % 5 == 0 else ("x" if i % 2 else "y")) for i in range(40)]
SCHEMA = "k long, v double, s string"


def test_recipe_zero_steps_is_source_and_log(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    r = Recipe([Step("Missing Values", "Fill with Mean", ("v",)), Step("Missing Values", "Ignore", ("s",))],
               order_by=["k"])
    assert sorted(r.apply(df, upto=0).collect()) == sorted(df.collect())
    assert [x.text for x in r.log(spark).orderBy("step").collect()] == [
        "Fill with Mean applied to v for Missing Values", "Ignore applied to s for Missing Values"]
    a = r.analysis(df)
    assert a.stats["v"]["missing"] == 0
    assert a.issue_counts().where("column = 's'").first().missing == 0   # ignored
    assert a.stats["s"]["missing"] == 8


def test_removed_rows_with_null_keys(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, "a")], "a int, b string")
    after = spark.createDataFrame([(1, None), (2, "a")], "a int, b string")
    got = removed_rows(df, after).collect()
    assert len(got) == 1 and got[0].a == 1 and got[0].b is None
    s = step_summary(df, after).first()
    assert (s.rows_removed, s.rows_remaining) == (1, 2)


def test_changed_rows_null_safe(spark):
    b = spark.createDataFrame([(0, None), (1, 1.0), (2, 2.0)], "_row_id long, v double")
    a = spark.createDataFrame([(0, 5.0), (1, 1.0), (2, None)], "_row_id long, v double")
    assert sorted(r._row_id for r in changed_rows(b, a).collect()) == [0, 2]


def test_reprofile_equals_full(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    old = profile(df)
    df2 = df.withColumn("v", F.coalesce("v", F.lit(0.0)))
    new = {r.column: r for r in reprofile(df2, old, ["v"]).collect()}
    full = {r.column: r for r in profile(df2).collect()}
    for c in ("k", "v", "s"):
        assert new[c].missing == full[c].missing and new[c].distinct == full[c].distinct
        assert new[c].median == full[c].median


def test_kpis_and_slicers(spark):
    df = spark.createDataFrame([(i, f"c{i % 3}", float(i) * 10, float(i)) for i in range(30)],
                               "row int, cat string, total_sales double, price double")
    cls = classes_of(df)
    assert cls["cat"] == "Categorical_LowCard" and cls["total_sales"] == "Numeric"
    k = {r.title: r for r in kpis(df, cls, "Generic").collect()}
    assert k["Total Records"].value == 30
    assert k["Sum total_sales"].value == sum(float(i) * 10 for i in range(30))
    assert k["Average price"].format == "currency"
    s = {r.column: r for r in slicers(df, cls).collect()}
    assert list(s["cat"].options) == ["c0", "c1", "c2"]


def test_planner_and_recommender(spark):
    df = spark.createDataFrame([(float(i), float(i) * 2 + (i % 3), f"g{i % 4}") for i in range(60)],
                               "a double, b double, g string")
    plans = plan_charts(df)
    kinds = [p["type"] for p in plans]
    # |r| ~ 1 scores the scatter at 70 + 30|r| = 100, above the heatmap's 95
    assert kinds[:2] == ["scatter", "heatmap"] and "histogram" in kinds and "pie" in kinds
    assert all(plans[i]["score"] >= plans[i + 1]["score"] for i in range(len(plans) - 1))
    dirty = spark.createDataFrame(ROWS, SCHEMA)
    rec = {(r.column, r.issue): r.method for r in recommend_methods(column_table(Analysis(dirty))).collect()}
    assert rec[("v", "Missing Values")] == "Fill with Mean"
    assert rec[("s", "Missing Values")] == "Fill with Mode"


def test_removed_by_id_and_counts(spark):
    from tablecare.operators.diff import removed_counts
    b = spark.createDataFrame([(0, "a"), (1, "a"), (2, "b")], "_row_id long, s string")
    a = b.where("_row_id != 1")
    assert [r._row_id for r in removed_rows(b, a).collect()] == [1]
    c = removed_counts(b.drop("_row_id"), a.drop("_row_id")).collect()
    assert [(r.s, r.removed) for r in c] == [("a", 1)]


def test_report_pieces(spark):
    from tablecare.plans.quality import quality_report
    rows = [(None, None, None, 1.0), ("a", " ", None, 2.0), ("b", "x", "y", None)] * 5
    a = Analysis(spark.createDataFrame(rows, "p string, q string, r string, v double"))
    rep = quality_report(a)
    assert rep["poor_quality_rows"].count() == 5          # 3 of 4 columns blank
    top = [r.column for r in rep["top_missing"].collect()]
    assert top[0] == "r"
    assert {r["class"] for r in rep["class_counts"].collect()} >= {"Categorical"}


def test_empty_table(spark):
    from tablecare.operators.dashboard import auto_dashboard
    from tablecare.plans.quality import quality_report
    df = spark.createDataFrame([], "a string, b double")
    rep = quality_report(Analysis(df))
    assert rep["error"].first().error == "Dataset is empty."
    assert auto_dashboard(df) == []


def test_step_preview(spark):
    from tablecare.plans.quality import preview
    df = spark.createDataFrame(ROWS, SCHEMA)
    p = preview(Analysis(df), "Missing Values", ["v"], "Fill with Mean", order_by=["k"])
    m = p["metrics"].first()
    assert m.rows_removed == 0 and m.values_changed == 10 and m.improvement >= 0
    assert p["before"].count() == 5 and p["after"].where("v IS NULL").count() == 0
    d = preview(Analysis(df), "Missing Values", ["s"], "Drop Rows", order_by=["k"])
    assert d["metrics"].first().rows_removed == 8


def test_preview_counts_unchanged_columns_once(spark, monkeypatch):
    from tablecare.operators import analysis, diff
    from tablecare.operators.clean import clean
    from tablecare.operators.rowid import with_row_id
    from tablecare.plans.quality import preview, quality_scores
    rows = [(i, None if i % 4 == 0 else float(i % 9) * (-1) ** i, f"{i % 30}.5" if i % 40 else "n/a", "  " if i % 7 == 0 else "Ab" if i % 5 else "aB", -0.0 if i % 2 else 0.0) for i in range(120)]
    df = spark.createDataFrame(rows, "k long, `v.x` double, n string, s string, z double")
    counted, compared = [], []
    for name in ("distinct_stats", "quantile_stats"):
        real = getattr(analysis, name)
        monkeypatch.setattr(analysis, name, lambda d, columns, *a, real=real, name=name: counted.append((name, *columns)) or real(d, columns, *a))
    real_rows = diff.changed_rows
    monkeypatch.setattr(diff, "changed_rows", lambda *a: compared.append(1) or real_rows(*a))
    every = ("k", "v.x", "n", "s", "z")
    for issue, cols, method, custom, again, joins in (
            ("Constant Columns", ["s", "z"], "Drop Column", None, [], 0),
            ("Missing Values", ["v.x"], "Replace with Custom Value", "7", ["v.x"], 1),
            ("Extra Spaces", ["s"], "Trim Spaces", None, ["s"], 1),
            ("Missing Values", ["n"], "Drop Rows", None, list(every), 0)):
        counted.clear()
        compared.clear()
        p = preview(Analysis(df), issue, cols, method, custom, order_by=["k"])
        assert [c for name, *c in counted if name == "distinct_stats"] == [list(every)] + [again] * bool(again)
        assert len(compared) == joins  # rows are compared once, and only where none was removed
        monkeypatch.setattr(diff, "changed_rows", real_rows)
        base = Analysis(with_row_id(df, ["k"]))
        after = clean(base, issue, cols, method, custom, order_by=["k"])
        fresh = Analysis(after)
        m = p["metrics"].first()
        assert m.current_score == quality_scores(base).first()["overall"] and m.estimated_score == quality_scores(fresh).first()["overall"]
        monkeypatch.setattr(diff, "changed_rows", lambda *a: compared.append(1) or real_rows(*a))
        known = Analysis(after, known=(base, {c for c in every if c not in again}))
        assert sorted(map(str, known.profile_df.collect())) == sorted(map(str, fresh.profile_df.collect()))
        if joins:
            b, c = ({r._row_id: r for r in p[x].collect()} for x in ("before", "after"))
            changed = sorted(r._row_id for r in real_rows(base.typed, after).collect())
            assert sorted(b) == sorted(c) == changed[:5]


def test_dashboard_composite(spark):
    from tablecare.operators.dashboard import dashboard, filtered_dashboard
    df = spark.createDataFrame([(f"c{i % 3}", float(i), f"r{i % 7}") for i in range(40)],
                               "cat string, amount double, region string")
    d = dashboard(df)
    s = d["summary"].first()
    assert (s.rows, s.cols, s.numeric) == (40, 3, 1) and 0 <= s.quality <= 100
    kinds = [k for k, _, _ in d["charts"]]
    assert "donut" in kinds and "horizontal_bar" in kinds and "histogram" in kinds
    f = filtered_dashboard(df, {"cat": ["c0"]}, d["classes"])
    assert f["kpis"].where("title = 'Total Records'").first().value == 14
