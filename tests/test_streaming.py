"""The missing/empty counters give the same numbers on a file stream."""

import tempfile

from tablecare.streaming import flag_cells, missing_empty_counts


def test_stream_counts_equal_batch(spark):
    rows = [("a", "NULL"), (" ", "x"), (None, "n/a"), ("b", "")]
    df = spark.createDataFrame(rows, "p string, q string")
    folder = tempfile.mkdtemp(prefix="tc-stream-")
    df.write.mode("overwrite").parquet(folder + "/in")
    batch = missing_empty_counts(df).first().asDict()
    stream = spark.readStream.schema(df.schema).parquet(folder + "/in")
    q = (missing_empty_counts(stream).writeStream.outputMode("complete").format("memory")
         .queryName("tc_counts").option("checkpointLocation", folder + "/ck").trigger(availableNow=True).start())
    q.awaitTermination(120)
    got = spark.sql("SELECT * FROM tc_counts").first().asDict()
    assert got == batch == {"rows": 4, "p_missing": 1, "p_empty": 1, "q_missing": 2, "q_empty": 1}
    flags = {tuple(r._missing_cols) for r in flag_cells(df).collect()}
    assert ("q",) in flags and ("p", "q") in flags
