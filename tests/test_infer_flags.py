"""Typing, invalid types, categories, outliers, cleaners (FIXTURES F2, F3)."""

from pyspark.sql import functions as F

from tablecare.operators.analysis import Analysis
from tablecare.operators.clean import clean

F2 = [
    ("1", "25.5", "A", "50000", "Engineering", "2023-01-01", "Active", "95", "good", "true"),
    ("2", None, "B", "NULL", "Sales", "2023-01-02", "Inactive", None, "bad", "false"),
    ("3", "NaN", "C", " ", "HR", "2023-01-03", "Active", "88", None, "true"),
    ("4", " 30 ", "D", "60000", "Engineering", "2023-01-04", "Active", "100", "ok", "true"),
    ("5", "NULL", "E", "70000", "Marketing", "2023-01-05", None, "92", None, "false"),
]
F2_SCHEMA = ("id string, age string, name string, salary string, department string, date string, status string, "
             "score string, notes string, is_active string")


def test_promotion_rules(spark):
    df = spark.createDataFrame(F2 * 3, F2_SCHEMA)
    a = Analysis(df)
    assert sorted(a.plan.promoted) == ["id", "salary", "score"]
    st = a.stats
    assert (st["age"]["missing"], st["age"]["empty"], st["age"]["valid"]) == (9, 0, 6)
    assert (st["salary"]["missing"], st["salary"]["empty"], st["salary"]["valid"]) == (3, 3, 9)
    assert dict(a.typed.dtypes)["salary"] == "double"
    assert dict(a.typed.dtypes)["age"] == "string"


def test_invalid_email_and_phone(spark):
    rows = [(f"user{i}@example.com", f"+1 555 010 000{i}") for i in range(9)] + [("not-an-email", "abc")]
    a = Analysis(spark.createDataFrame(rows, "email string, phone string"))
    assert a.plan.pattern == {"email": "email", "phone": "phone"}
    f = a.flag_frame().where(F.size("_invalid_type_cols") > 0).collect()
    assert len(f) == 1 and list(f[0]._invalid_type_cols) == ["email", "phone"]


def test_inconsistent_categories(spark):
    vals = ["Apple"] * 5 + ["apple"] * 2 + ["APPLE"] + ["Pear"] * 2
    a = Analysis(spark.createDataFrame([(v,) for v in vals], "category string"))
    t = {r.value: r.dominant for r in a.category_table.collect()}
    assert t == {"apple": "Apple", "APPLE": "Apple"}
    flagged = a.flag_frame().where(F.size("_inconsistent_category_cols") > 0).count()
    assert flagged == 3


def test_outlier_iqr_needs_ten_values(spark):
    a = Analysis(spark.createDataFrame([(float(v),) for v in list(range(1, 12)) + [1000]], "amount double"))
    assert a.outlier_rules["amount"]["method"] == "IQR"
    out = a.flag_frame().where(F.size("_outlier_cols") > 0).select("amount").collect()
    assert [r.amount for r in out] == [1000.0]
    few = Analysis(spark.createDataFrame([(float(v),) for v in range(1, 10)], "amount double"))
    assert few.outlier_rules["amount"]["method"] is None


def test_special_chars_and_dates(spark):
    a = Analysis(spark.createDataFrame([("é-a_b@c.d,#!x",)], "text string"))
    got = clean(a, "Special Characters", ["text"], "Remove Special Characters").first().text
    assert got == "é-a_b@c.d,x"
    d = Analysis(spark.createDataFrame([("2023-01-02",), ("01/02/2023",), ("2023-01-02 03:04:05",), ("x",)], "w string"))
    out = [r.w for r in clean(d, "Date Format Problems", ["w"], "Convert to Single Format").collect()]
    assert [str(v) if v else None for v in out] == ["2023-01-02 00:00:00", "2023-01-02 00:00:00",
                                                    "2023-01-02 03:04:05", None]


def test_fill_then_reflag_is_clean(spark):
    rows = [(float(i) if i % 4 else None, "a" if i % 3 else "N/A") for i in range(40)]
    a = Analysis(spark.createDataFrame(rows, "x double, s string"))
    out = clean(a, "Missing Values", ["x", "s"], "Fill with Mode")
    b = Analysis(out)
    assert b.stats["x"]["missing"] == 0 and b.stats["s"]["missing"] == 0
    # missing + empty + valid = rows for every column
    for c, st in a.stats.items():
        assert st["missing"] + st["empty"] + st["valid"] == st["rows"]


def test_unknown_method_raises(spark):
    a = Analysis(spark.createDataFrame([(1.0,)], "x double"))
    try:
        clean(a, "Outliers", ["x"], "Do Something")
    except ValueError:
        return
    raise AssertionError("expected ValueError")


def test_wide_table_is_chunked(spark):
    from pyspark.sql import functions as F
    cols = [F.when(F.col("id") % (i + 2) == 0, None).otherwise(F.col("id") * (i + 1)).cast("double").alias(f"c{i}")
            for i in range(120)]
    df = spark.range(0, 200).select(*cols, F.lit("N/A").alias("t"))
    a = Analysis(df)
    assert len(a.stats) == 121
    assert a.stats["c0"]["missing"] == 100 and a.stats["c118"]["missing"] == 2
    counts = {r.column: r.missing for r in a.issue_counts().collect()}
    assert counts["c119"] == 2 and counts["t"] == 200
