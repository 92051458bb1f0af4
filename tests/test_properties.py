"""Property checks: the Spark predicates agree with a plain statement of the
rules on arbitrary text, and every cell is exactly one of missing / empty /
valid."""

import re

from hypothesis import given, settings, strategies as st
from pyspark.sql import types as T

from tablecare.functions import predicates as P

WS = P.WHITESPACE
ALPHABET = st.sampled_from(list("aA1-.9 \t\n?/#") + ["null", "NaN", "n/a", "NA", " ", "　", " ", "é"])
CELL = st.one_of(st.none(), st.lists(ALPHABET, max_size=6).map("".join))
NUM = re.compile(r"^-?\d+\.?\d*\Z")


def expected(v):
    if v is None:
        return "missing"
    s = v.strip(WS)
    if s.lower() in P.MISSING_TOKENS:
        return "missing"
    if s == "":
        return "empty"
    return "valid"


@settings(max_examples=25, deadline=None)
@given(st.lists(CELL, min_size=1, max_size=40))
def test_cells_partition(spark, cells):
    df = spark.createDataFrame([(c,) for c in cells], "c string")
    st_ = T.StringType()
    rows = df.select("c", P.is_missing("c", st_).alias("m"), P.is_empty("c", st_).alias("e"),
                     P.is_valid("c", st_).alias("v"), P.matches("c", "numeric").alias("n")).collect()
    for r in rows:
        kinds = [k for k, flag in (("missing", r.m), ("empty", r.e), ("valid", r.v)) if flag]
        assert kinds == [expected(r.c)], (r.c, kinds)
        assert bool(r.n) == bool(r.c is not None and NUM.match(r.c)), r.c
