"""Every public operator takes column names as users write them."""

import datetime

from pyspark.sql import functions as F

import tablecare as tc
from tablecare.operators import charts as C, classify, dashboard as D, profile as prof
from tablecare.operators.analysis import outlier_preview, outlier_report
from tablecare.operators.diff import changed_rows, removed_counts, removed_rows, step_summary
from tablecare.operators.rowid import with_row_id
from tablecare.plans import planner, quality
from tablecare.plans.recommend import recommend

PRICE, KIND, DAY, SIDE = "unit.price", "kind of `thing`", "day ordered", "side.b"


def a_table(spark):
    rows = [(i, float(i % 40) if i % 9 else (None if i % 2 else 4000.0), ["Apple", "apple", "Pear", " ", None][i % 5],
             datetime.datetime(2023, 1 + i % 12, 1 + i % 28), "left" if i % 3 else "right") for i in range(240)]
    df = spark.createDataFrame(rows, "n long, price double, kind string, day timestamp, side string")
    return df.toDF("n", PRICE, KIND, DAY, SIDE)


def ran(df):
    return df.collect()


def test_table_operators(spark):
    df = with_row_id(a_table(spark), ["n"])
    assert len(ran(tc.apply_filters(df, {KIND: ["Pear"], PRICE: {"min": 3, "max": 9}}))) > 0
    assert [r[PRICE] for r in ran(tc.sort_by(df, PRICE, True).where(F.col(f"`{PRICE}`").isNotNull()).limit(1))] == [4000.0]
    for op in (lambda: tc.sort_as_text(df, KIND), lambda: tc.head(df, 3), lambda: tc.search(df, "pea"), lambda: tc.hash_sample(df, 5),
               lambda: tc.even_sample(df, 10), lambda: tc.page(tc.sort_by(df, PRICE), 2, 10)):
        assert len(ran(op())) > 0
    assert ran(tc.extra_duplicates(df))[0][0] == 0
    assert len(ran(tc.duplicate_groups(df, [KIND, SIDE], normalise=False))) > 0 and ran(tc.duplicate_totals(df, [KIND]))
    for which in ("first", "last", "most_complete"):
        assert len(ran(tc.keep(df, [KIND, SIDE], which))) <= 15
    after = df.withColumn(PRICE, F.col(f"`{PRICE}`") + 1)
    assert ran(changed_rows(df, after))[0].changed_columns == [PRICE]
    assert ran(removed_rows(df, after)) == [] and ran(removed_counts(df.drop("_row_id"), after.drop("_row_id"))) and ran(step_summary(df, after))


def test_analysis_and_cleaning(spark):
    df = a_table(spark)
    a = tc.Analysis(df)
    assert len(ran(a.flag_frame())) == 240 and len(ran(a.profile_df)) == 5
    for op in (a.issue_counts, a.outlier_table, a.duplicate_rows_total, lambda: outlier_report(a), lambda: tc.outlier_extremes(a),
               lambda: tc.quality_scores(a), lambda: tc.column_health(a), lambda: recommend(a), lambda: tc.recommendations(a)):
        ran(op())
    assert len(ran(outlier_preview(a, PRICE, "n"))) == 5
    for frame in tc.quality_report(a).values():
        ran(frame)
    for issue, cols, method in (("Missing Values", [PRICE], "Fill with Median"), ("Missing Values", [KIND], "Fill with Mode"),
                                ("Missing Values", [PRICE, KIND], "Fill using Previous Value"), ("Missing Values", [PRICE], "Linear Interpolation"),
                                ("Empty Cells", [KIND], "Trim Spaces"), ("Empty Cells", [KIND], "Replace with NULL"),
                                ("Outliers", [PRICE], "Cap Values"), ("Outliers", [PRICE], "Remove Outliers"), ("Extra Spaces", [KIND], "Trim Spaces"),
                                ("Special Characters", [KIND], "Remove Special Characters"), ("Inconsistent Categories", [KIND], "Standardize Format"),
                                ("Invalid Data Types", [KIND], "Convert to Numeric"), ("Date Format Problems", [KIND], "Convert to Single Format"),
                                ("Duplicate Rows", ["all"], "Keep First Occurrence"), ("Duplicate Rows", [KIND], "Keep Last")):
        out = tc.clean(a, issue, cols, method, order_by=["n"])
        assert ran(out) and out.columns == df.columns
    rows, stats = tc.table_page(tc.Analysis(with_row_id(df, ["n"])), search_term="pear", sort=PRICE, limit=5)
    assert len(ran(rows)) == 5 and ran(stats)
    p = prof.profile(df)
    assert len(ran(prof.reprofile(df, p, [PRICE]))) == 5
    for classes in (classify.quality_classes, classify.dashboard_classes, classify.auto_classes, classify.column_anomalies):
        ran(classes(p))


def test_charts_and_dashboards(spark):
    df = a_table(spark)
    for op in (C.value_counts(df, KIND, 3, "none"), C.sum_by(df, KIND, PRICE, 3, "none"), C.sum_by_date(df, DAY, PRICE),
               C.sum_matrix(df, KIND, SIDE, PRICE), C.sum_matrix(df, KIND, SIDE, PRICE, True), C.mean_by(df, KIND, PRICE), C.monthly_mean(df, DAY, PRICE),
               C.trend_summary(C.monthly_mean(df, DAY, PRICE), PRICE), C.crosstab(df, KIND, SIDE), C.corr_matrix(df, ["n", PRICE]),
               C.histogram(df, PRICE), C.box_summary(df, KIND, PRICE), C.upper_anomalies(df, [PRICE]), C.scatter_sample(df, PRICE, "n", 5)):
        assert len(ran(op)) > 0
    assert ran(df.agg(C.count_matching(df, KIND, "PEA").alias("n")))[0].n == 48
    found = D.dashboard(df)
    for key in ("kpis", "slicers", "insights", "summary", "sample"):
        ran(found[key])
    for _, _, data in found["charts"] + D.filtered_dashboard(df, {KIND: ["Pear"]}, found["classes"])["charts"]:
        ran(data)
    for _, _, _, data in D.auto_dashboard(df) + D.refresh_charts(df, [("bar", KIND, "count"), ("line", DAY, PRICE), ("scatter", PRICE, "n"),
                                                                         ("histogram", PRICE, "count"), ("area", KIND, PRICE)]):
        assert ran(data)
    for op in (D.auto_kpis(df), D.auto_slicers(df), D.auto_insights(df), planner.plan_table(planner.plan_charts(df), spark)):
        assert ran(op)
    for plan in planner.plan_charts(df):
        ran(plan["data"])
    assert quality.column_table(tc.Analysis(df)).count() == 5
