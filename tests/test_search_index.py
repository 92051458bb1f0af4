"""Files that an index rules out hold no match; wide correlations equal the pairwise ones."""

import math
import random

import numpy as np
import pytest

from tablecare.operators import charts as C
from tablecare.operators.table import search
from tablecare.plans.profile_store import files_under
from tablecare.plans.search_index import SearchIndex, fixed_parts
from tablecare.session import scratch_path


@pytest.fixture(scope="module")
def files(spark):
    base = scratch_path(spark, "words")
    rows = {"a": [(1, "Alpha centauri", None), (2, None, "x.y"), (3, "", "ünïcode Größe")], "b": [(4, "beta 100% [sure]", "alp"), (5, "ha!", "😀😀😀 face")],
            "c": [(6, "gamma " * 5000 + "needle", "z"), (6, "gamma", "gamma")], "d": []}
    for name, part in rows.items():
        spark.createDataFrame(part, "id long, `te.xt` string, other string").coalesce(1).write.parquet(f"{base}/{name}")
    index = SearchIndex(spark, scratch_path(spark, "index"))
    assert len(index.update(files_under(spark, base))) == len(files_under(spark, base)) and index.update(files_under(spark, base)) == []
    return index, base


@pytest.mark.parametrize("term", ["alpha", "ALPHA", "al", "", "größe", "😀😀😀 f", "100% [s", "needle", "gamma gamma", "nowhere", "aaa", "x.y"])
def test_indexed_search_finds_the_same_rows(spark, files, term):
    index, base = files
    paths = [f"{base}/{d}" for d in "abcd"]
    whole = spark.read.parquet(*paths)
    for columns in (None, ["te.xt"]):
        got = [r for p in paths for r in index.search(p, term, columns=columns).collect()]
        assert sorted(map(str, got)) == sorted(map(str, search(whole, term, columns=columns).collect()))


def test_files_without_the_pieces_are_not_read(spark, files):
    index, base = files
    listed = files_under(spark, base)

    def held(*parts):
        return {p.split("/")[-2] for p in index.candidates(listed, list(parts))}

    assert held("needle") == {"c"} and held("centauri") == {"a"} and held("nowhere") == set()
    assert held("alpha") == {"a"}  # "alp" and "ha!" are cells of two columns
    assert held("al") == {"a", "b", "c", "d"}
    late = scratch_path(spark, "late")
    spark.createDataFrame([(9, "fresh needle")], "id long, t string").write.parquet(late)
    assert len(index.candidates(files_under(spark, late), ["nothing"])) == len(files_under(spark, late))  # not indexed: read


@pytest.mark.parametrize("pattern,parts", [("rights? reserved", ["right", " reserved"]), (r"a\.bcd+e", ["a.bcd"]), ("abc|def", []), ("(abc)", []),
                                           ("abcd*efg", ["abc", "efg"]), (r"\dabc", ["abc"]), ("x[abc]yzw", ["yzw"]), ("[]a]bcd", ["bcd"]), ("^abc$", ["abc"]),
                                           ("a{3}bcd", []), (".*", []), (r"foo\wbar\\z", ["foo", "bar\\z"]), ("abc+?def", ["abc", "def"])])
def test_fixed_parts_of_patterns(pattern, parts):
    assert fixed_parts(pattern) == parts


def test_wide_correlations_equal_pairwise_ones(spark):
    rnd = random.Random(3)
    names = [f"a{i}" for i in range(17)] + ["con.stant", "almost", "empty", "odd"]
    rows = []
    for i in range(900):
        base = rnd.gauss(1e6, 3)
        row = [None if rnd.random() < .1 else base * (k % 3) + rnd.gauss(0, 1 + k) for k in range(17)]
        rows.append((*row, 0.1, 5.0 if i else 5.5, None, float("nan") if i == 7 else float(i)))
    df = spark.createDataFrame(rows, ", ".join(f"`{n}` double" for n in names)).repartition(5)
    got = {(r.x, r.y): r.r for r in C.corr_matrix(df, names, 6).collect()}
    assert len(got) == len(names) ** 2
    some = names[:3] + names[17:]
    for r in C.corr_matrix(df, some, 6).collect():
        assert got[r.x, r.y] == pytest.approx(r.r, abs=2e-6, nan_ok=True), (r.x, r.y)
    assert math.isnan(got["odd", "a0"]) and got["con.stant", "a1"] == 0.0 == got["empty", "empty"]
    assert C.corr_matrix(df.limit(0), names).where("r <> 0").count() == 0


def test_correlations_of_three_hundred_columns(spark):
    x = np.random.default_rng(5).normal(size=(200, 300)).round(6)
    x[:, 1] = x[:, 0] * 2 + x[:, 1] / 10
    names = [f"c{i}" for i in range(300)]
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], ", ".join(f"{n} double" for n in names))
    got = {(r.x, r.y): r.r for r in C.corr_matrix(df, names, 4).collect()}
    want = np.corrcoef(x.T)
    assert len(got) == 90_000 and all(abs(got[f"c{i}", f"c{j}"] - want[i, j]) < 1e-4 for i in range(0, 300, 7) for j in range(300))


def test_an_index_gives_bits_not_pieces_to_the_shuffle(spark, monkeypatch):
    from pyspark.sql import functions as F

    from tablecare.plans import search_index as S
    monkeypatch.setattr(S, "HELD", 2)
    rows = [("a", "Abc", None), ("b", "xy", "äbcd"), ("a", "cab", "z"), (None, "null's", ""), ("c", None, "long " * 500_000 + "tail"), ("a", "q", "bca")]
    df = spark.createDataFrame(rows, "f string, `t.t` string, u string").coalesce(2)
    found = S.file_pieces(df, "f")
    plan = found._jdf.queryExecution().toString()
    assert "MapInArrow" in plan and "Generate" not in plan  # it was a row a piece
    got = {(r.file, r.column, r.part * S.PIECE + k) for r in found.collect() for k in range(S.PIECE) if r.bits[k // 8] >> k % 8 & 1}
    want = {(f, c, int(p)) for f, *cells in rows for c, x in zip(("t.t", "u"), cells) for b in [(x or "").lower().encode()]
            for p in (S._places(S.np.frombuffer(b, S.np.uint8)) if len(b) > 2 else [])}
    assert got == want
    assert found.groupBy("file", "column", "part").agg(F.count(F.lit(1)).alias("n")).where("n > 1").count() == 0


def test_a_frequent_language_lies_in_several_files(spark, monkeypatch, tmp_path):
    from tablecare.plans import scale_queries as Q
    text = " ".join(f"{i * 7919:x}" for i in range(300))
    spark.range(0, 3000, 1, 8).selectExpr("id AS doc_id", f"concat(id, ' {text} ', sha2(cast(id AS string), 512)) AS text", "CASE WHEN id % 50 = 0 THEN 'xx' ELSE 'en' END AS lang",
                                          "'s' AS source", "0 AS n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(Q.SearchIndex, "update", lambda self, files: None)
    before = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64k")
    try:
        base = Q._indexed_documents(spark, str(tmp_path))[1]
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", before)
    docs = spark.read.parquet(base)
    assert docs.count() == 3000
    assert docs.where("lang = 'en'").selectExpr("_metadata.file_path AS f").distinct().count() > 1  # it was one task and file
