"""Readers and sinks (A1-A7) on small files written by the test."""

import os
import tempfile

import pytest

from tablecare.sources.io import load_dataset, overview, read_csv, read_table, table_summary, write_csv


def _write(folder, name, text):
    path = os.path.join(folder, name)
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)
    return path


def test_csv_all_string_multiline_and_bad_rows(spark):
    d = tempfile.mkdtemp(prefix="tc-src-")
    p = _write(d, "t.csv", 'id,age,note\n1,25.5,"two\nlines"\n2,NULL,plain\n3,x,"a ""quoted"" word"\n4\n')
    df = read_csv(spark, p, multiLine="true")     # quoted fields that span lines are asked for
    assert [t for _, t in df.dtypes] == ["string", "string", "string"]
    rows = {r.id: r for r in df.collect()}
    assert rows["1"].note == "two\nlines" and rows["3"].note == 'a "quoted" word'
    assert rows["4"].age is None                      # short row kept, missing fields null


def test_tsv_json_and_dispatch(spark):
    d = tempfile.mkdtemp(prefix="tc-src-")
    t = read_table(spark, _write(d, "t.tsv", "a\tb\n1\tx y\n"))
    assert t.first().b == "x y"
    j = read_table(spark, _write(d, "t.json", '[{"a": 1, "b": "x"}, {"a": 2, "b": null}]'))
    assert dict(j.dtypes) == {"a": "bigint", "b": "string"} and j.count() == 2
    with pytest.raises(ValueError):
        read_table(spark, _write(d, "t.xlsx", ""))
    ds = load_dataset(spark, {"first": os.path.join(d, "t.tsv"), "second": os.path.join(d, "t.json")})
    assert list(ds) == ["first", "second"]


def test_overview_summary_and_csv_sink(spark):
    d = tempfile.mkdtemp(prefix="tc-src-")
    df = spark.createDataFrame([(1, "a", 2.5)], "n int, s string, x double")
    kinds = {r.column: r.kind for r in overview(df).collect()}
    assert kinds == {"n": "numeric", "s": "categorical", "x": "numeric"}
    out = os.path.join(d, "out.csv")
    write_csv(df, out, quote_all=True)
    back = read_table(spark, out)
    assert back.first().asDict() == {"n": "1", "s": "a", "x": "2.5"}
    s = table_summary(back).first()
    assert (s.rows, s.cols) == (1, 3) and s.file_bytes > 0


def test_text_files_split(spark):
    """A large CSV, TSV or JSON-lines file is read by several tasks; an array of records is recognised."""
    d = tempfile.mkdtemp(prefix="tc-src-")
    body = "".join(f"{i},value {i}\n" for i in range(60_000))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(200_000))
    try:
        assert read_table(spark, _write(d, "big.csv", "id,note\n" + body)).rdd.getNumPartitions() > 1
        assert read_table(spark, _write(d, "big.tsv", "id\tnote\n" + body.replace(",", "\t"))).rdd.getNumPartitions() > 1
        lines = read_table(spark, _write(d, "big.json", "".join(f'{{"id": {i}, "note": "v"}}\n' for i in range(60_000))))
        assert lines.rdd.getNumPartitions() > 1 and lines.count() == 60_000
        array = read_table(spark, _write(d, "array.json", '[\n {"id": 1,\n "note": "a"},\n {"id": 2, "note": "b"}]\n'))
        assert array.count() == 2 and array.columns == ["id", "note"]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
