"""Missing vs empty on the reference's own test cells (FIXTURES F1)."""

from pyspark.sql import functions as F, types as T

from tablecare.functions import predicates as P
from tablecare.operators.analysis import Analysis
from tablecare.plans.quality import quality_scores

CELLS = ["NaN", "NULL", None, "NA", "", "   ", "\t", " \n ", "Valid", "123"]


def test_missing_empty_counts(spark):
    df = spark.createDataFrame([(v,) for v in CELLS], "mixed_col string")
    st = T.StringType()
    r = df.agg(F.count_if(P.is_missing("mixed_col", st)).alias("m"),
               F.count_if(P.is_empty("mixed_col", st)).alias("e")).first()
    assert (r.m, r.e) == (4, 4)


def test_missing_empty_never_both(spark):
    df = spark.createDataFrame([(v,) for v in CELLS + [" ", "　x ", "n/a "]], "c string")
    st = T.StringType()
    assert df.where(P.is_missing("c", st) & P.is_empty("c", st)).count() == 0
    # Unicode whitespace is stripped like the reference's strip
    assert df.where(P.is_empty("c", st)).count() == 5
    assert df.where(F.col("c") == "　x ").select(P.strip_ws("c").alias("s")).first().s == "x"


def test_scores_on_reference_cells(spark):
    df = spark.createDataFrame([(v,) for v in CELLS], "mixed_col string")
    a = Analysis(df)
    p = a.profile_df.first()
    assert (p.missing, p.empty) == (4, 4)
    assert round(p.missing / p.rows * 100, 2) == 40.0
    assert round(p.empty / p.rows * 100, 2) == 40.0
    s = quality_scores(a).first()
    assert s.completeness == 20.0


def test_patterns_use_whole_cell(spark):
    df = spark.createDataFrame([("12",), ("12\n",), ("-3.5",), ("1.",), (" 30 ",), ("a1",)], "v string")
    got = [r.v for r in df.where(P.matches("v", "numeric")).collect()]
    assert sorted(got) == ["-3.5", "1.", "12"]
