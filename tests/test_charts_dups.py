"""Chart aggregates and duplicate handling: algebraic checks."""

from pyspark.sql import functions as F

from tablecare.operators import charts as C
from tablecare.operators.duplicates import duplicate_groups, keep


def test_histogram_counts_every_value_once(spark):
    df = spark.range(0, 1000).select((F.col("id") * 0.37).alias("x"))
    for bins, closed in ((20, "right"), (10, "left"), (15, "left")):
        h = C.histogram(df, "x", bins, closed).collect()
        assert len(h) == bins and sum(r.n for r in h) == 1000


def test_histogram_constant_and_corr_constant(spark):
    df = spark.createDataFrame([(5.0, float(i)) for i in range(20)], "c double, x double")
    h = C.histogram(df, "c", 20, "right").collect()
    assert sum(r.n for r in h) == 20
    r = {(x.x, x.y): x.r for x in C.corr_matrix(df, ["c", "x"]).collect()}
    assert r[("c", "x")] == 0.0 and r[("x", "x")] == 1.0


def test_keep_first_last_most_complete(spark):
    rows = [(1, "a", None, 0), (1, "a", None, 1), (2, "b", "z", 2), (1, "a", "q", 3)]
    df = spark.createDataFrame(rows, "k int, s string, t string, _row_id long")
    first = sorted(r._row_id for r in keep(df, ["k", "s"], "first").collect())
    last = sorted(r._row_id for r in keep(df, ["k", "s"], "last").collect())
    full = sorted(r._row_id for r in keep(df, ["k", "s"], "most_complete").collect())
    assert (first, last, full) == ([0, 2], [2, 3], [2, 3])
    g = duplicate_groups(df.drop("_row_id"), keys=["k", "s"], order_by=["k", "t"]).collect()
    assert len(g) == 1 and g[0].group_rows == 3


def test_row_id_is_carried_not_analysed(spark):
    from tablecare.operators.analysis import Analysis
    from tablecare.operators.rowid import with_row_id
    df = with_row_id(spark.createDataFrame([("a", 1.0), ("a", 1.0), ("b", 2.0)], "s string, x double"), ["s"])
    a = Analysis(df)
    assert a.columns == ["s", "x"] and "_row_id" in a.typed.columns
    dups = sorted(r._row_id for r in a.flag_frame().where("_is_duplicate").collect())
    assert dups == [0, 1]
