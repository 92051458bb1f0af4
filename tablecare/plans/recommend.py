"""Clean-method recommender.

The reference asks a hosted model with a prompt that states its rules; here
the rules themselves run as a ``when`` chain over the per-column table of the
quality report (one row per column).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

# --- fixed values: column names taken as business transactions ---------------
AMOUNT_WORDS = ("price", "amount", "salary", "revenue")
# --- end of fixed values ----------------------------------------------------


def recommend_methods(cols: DataFrame, duplicate_rows: int = 0) -> DataFrame:
    """``(column, issue, method)`` for each active column with an issue.

    ``cols`` is ``plans.quality.column_table``.  Rules: missing > 50 % ->
    Drop Column; numeric with outliers -> Median, without -> Mean;
    categorical -> Mode; date -> Forward Fill.  Empty cells: numeric Mean,
    categorical Mode, text Custom Value, date Previous Value.  Outliers under
    1 % -> Manual Review; business amounts -> Keep Outliers; otherwise
    Replace using Median.  Exact duplicate rows -> Remove Exact Duplicates.
    """
    act = cols.where("active")
    name = F.lower(F.col("column"))
    amount = name.contains(AMOUNT_WORDS[0])
    for w in AMOUNT_WORDS[1:]:
        amount = amount | name.contains(w)
    miss_pct = F.col("missing") / F.col("rows") * 100
    out_pct = F.col("outliers") / F.col("rows") * 100
    cls = F.col("class")
    missing = (F.when(miss_pct > 50, "Drop Column")
                .when((cls == "Numeric") & (F.col("outliers") > 0), "Fill with Median")
                .when(cls == "Numeric", "Fill with Mean")
                .when(cls == "Date", "Fill using Previous Value")
                .otherwise("Fill with Mode"))
    empty = (F.when(cls == "Numeric", "Replace with Mean").when(cls == "Categorical", "Replace with Mode")
              .when(cls == "Date", "Replace with Previous Value").otherwise("Replace with Custom Value"))
    outliers = (F.when(out_pct < 1, "Manual Review").when(amount, "Keep Outliers")
                 .otherwise("Replace using Median"))
    recs = [
        act.where(F.col("missing") > 0).select("column", F.lit("Missing Values").alias("issue"), missing.alias("method")),
        act.where(F.col("empty") > 0).select("column", F.lit("Empty Cells").alias("issue"), empty.alias("method")),
        act.where(F.col("outliers") > 0).select("column", F.lit("Outliers").alias("issue"), outliers.alias("method")),
        act.where(F.col("invalid") > 0).select("column", F.lit("Invalid Data Types").alias("issue"),
                                                F.lit("Convert to Numeric").alias("method")),
        act.where(F.col("inconsistent")).select("column", F.lit("Inconsistent Categories").alias("issue"),
                                                 F.lit("Standardize Format").alias("method")),
    ]
    if duplicate_rows:
        recs.append(act.limit(1).select(F.lit("all").alias("column"), F.lit("Exact Duplicates").alias("issue"),
                                        F.lit("Remove Exact Duplicates").alias("method")))
    out = recs[0]
    for r in recs[1:]:
        out = out.unionByName(r)
    return out


def recommend(a) -> DataFrame:
    """The recommendations for an analysed table, its repeated rows included."""
    from .quality import column_table
    return recommend_methods(column_table(a), a.duplicate_rows_total().first()["duplicate_rows"])
