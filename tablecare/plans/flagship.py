"""Flagship query: per-column profile of ``lineitem`` with outlier bounds and
counts -- type decisions, missing/empty, moments, exact quantiles and the
chosen outlier rule in one long table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.analysis import Analysis
from .views import table


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = Analysis(table(spark, sf_dir, "lineitem"))
    prof = a.profile_df.select("column", "position", "dtype", "rows", "missing", "empty", "distinct", "n",
                               "mean", "std", "q1", "q3")
    return (prof.join(a.outlier_table(), "column", "left")
                .join(a.issue_counts().select("column", "outliers"), "column", "left")
                .orderBy("position"))
