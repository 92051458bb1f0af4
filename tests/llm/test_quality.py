import zlib

import pytest

from tablecare.llm.quality import Model, difference, quality_scores, train

BIG = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{BIG}/documents.parquet"), spark.read.parquet(f"{BIG}/labels.parquet")


def test_held_out_accuracy(tables):
    documents, labels = tables
    rows = quality_scores(documents, labels).join(labels, "doc_id").where("held_out").collect()
    bad = [r.predicted for r in rows if r.quality == 0]
    good = [r.predicted for r in rows if r.quality == 1]
    assert len(good) > 50 and len(bad) > 5
    assert sum(good) / len(good) >= 0.97 and sum(bad) / len(bad) <= 0.2


def test_folds_and_ranges(tables):
    documents, labels = tables
    rows = quality_scores(documents, labels).collect()
    assert len(rows) == documents.count()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)


def test_score_does_not_read_held_out_labels(tables, spark):
    documents, labels = tables
    other = labels.selectExpr("doc_id", "CASE WHEN crc32(cast(doc_id AS string)) % 4 = 2 THEN 1 - quality ELSE quality END AS quality")
    one = {r.doc_id: r.score for r in quality_scores(documents, labels).collect()}
    assert one == {r.doc_id: r.score for r in quality_scores(documents, other).collect()}


def test_edge_cases(spark, odd_documents, no_documents, tables):
    labels = spark.createDataFrame([(1, 1), (3, 0), (4, None), (None, 1), (5, 1), (6, 0), (5, 0)], "doc_id long, quality int")
    rows = quality_scores(odd_documents, labels).collect()
    assert len(rows) == odd_documents.count() and all(0 <= r.score <= 1 for r in rows)
    assert quality_scores(no_documents, tables[1]).collect() == []
    assert train(odd_documents, labels.where("quality = 1")) == Model(b"", b"", 0.0, pytest.approx(4.595, abs=1e-3))
    nothing = quality_scores(odd_documents, labels.limit(0)).collect()
    assert {r.score for r in nothing} == {0.5}
    assert difference(None, b"", b"") == difference("", b"", b"") == 0.0
