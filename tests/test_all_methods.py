"""Every issue x method pair offered by the reference's cleaning UI is
accepted and yields a table over the same or fewer rows."""

import pytest

from tablecare.operators.analysis import Analysis
from tablecare.operators.clean import clean

# fixed values: the UI's method lists per issue
METHODS = {
    "Missing Values": ["Fill with Mean", "Fill with Median", "Fill with Mode", "Fill using Previous Value",
                       "Fill using Next Value", "Linear Interpolation", "Replace with Custom Value",
                       "Delete Rows containing Missing Values", "Delete Columns containing Missing Values", "Ignore"],
    "Empty Cells": ["Replace with NULL", "Replace with Mean", "Replace with Median", "Replace with Mode",
                    "Replace with Previous Value", "Replace with Next Value", "Replace with Custom Value",
                    "Remove Rows containing Empty Cells", "Remove Columns containing Empty Cells", "Trim Spaces",
                    "Linear Interpolation", "Ignore"],
    "Outliers": ["Remove Outlier Rows", "Replace using Mean", "Replace using Median", "Replace using Percentile",
                 "Winsorization", "IQR Clipping", "Z-Score Clipping", "Cap Values", "Ignore"],
    "Duplicate Rows": ["Remove Exact Duplicates", "Keep First", "Keep Last", "Keep Most Complete Row", "Ignore"],
    "Near Duplicates": ["Merge Records", "Manual Review", "Keep First Occurrence"],
    "Duplicate Columns": ["Drop Column", "Keep As Is"],
    "Constant Columns": ["Drop Column", "Keep As Is"],
    "High Cardinality": ["Drop Column", "Keep As Is"],
    "Extra Spaces": ["Trim Spaces", "Keep As Is"],
    "Special Characters": ["Remove Special Characters", "Keep As Is"],
    "Invalid Data Types": ["Convert to Numeric", "Convert to String", "Keep As Is"],
    "Inconsistent Categories": ["Standardize Format", "Keep As Is"],
    "Date Format Problems": ["Convert to Single Format", "Keep As Is"],
    "High Null Percentage Columns": ["Drop Columns", "Keep As Is"],
}
PAIRS = [(i, m) for i, ms in METHODS.items() for m in ms]
ROWS = [(k, None if k % 4 == 0 else float(k % 9) * (50 if k == 33 else 1),
         [None, " ", "N/A", "Apple", "apple", " pear "][k % 6], "2023-01-02" if k % 2 else "01/02/2023")
        for k in range(40)] + [(3, 3.0, "apple", "2023-01-02")]


@pytest.fixture(scope="module")
def analysed(spark):
    return Analysis(spark.createDataFrame(ROWS, "k long, v double, s string, d string"))


@pytest.mark.parametrize("issue,method", PAIRS)
def test_pair_runs(analysed, issue, method):
    cols = ["d"] if issue == "Date Format Problems" else ["v", "s"]
    out = clean(analysed, issue, cols, method, custom_value="0", order_by=["k"])
    assert out.count() <= len(ROWS)
