"""Shared helpers: tables, shared scratch tables, Arrow slices, row keys."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablecare.session import checkpoint_dir

#: Rows of a text column handed to Python objects at once.
SLICE_ROWS = 256


def ship(spark: SparkSession) -> None:
    """Give the executors' Python this package, once for each application."""
    sc = spark.sparkContext
    package = Path(__file__).resolve().parents[1]
    if getattr(sc, "_tablecare_shipped", False) or not package.is_dir():
        return
    path = Path(tempfile.mkdtemp(prefix="tablecare-")) / "tablecare.zip"  # the driver serves it to all executors
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    sc.addPyFile(str(path))
    sc._tablecare_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back: later branches read
    the table instead of repeating the work, and a lost executor costs nothing.
    The folder goes when the application ends."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/tablecare-{uuid.uuid4().hex}"
    df.write.parquet(path)
    hadoop_path, files = _hadoop(spark, path)
    files.deleteOnExit(hadoop_path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def dropped(df: DataFrame) -> None:
    """Deletes what ``stored`` wrote for ``df``, which nothing reads again."""
    hadoop_path, files = _hadoop(df.sparkSession, df._stored_at)
    files.delete(hadoop_path, True)


def _hadoop(spark: SparkSession, path: str):
    hadoop_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path, hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most ``rows`` rows, so that the Python
    objects made from one slice stay small."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def batch_of(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema)], schema=schema)


def spread_id(id_col: Column) -> Column:
    """``id_col``, and a number of its own for every row whose id is null, so
    that rows without id do not meet in one group."""
    return F.coalesce(id_col.cast("long"), F.monotonically_increasing_id())


def fold(id_col: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts`` (a null id counts as '')."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % parts


#: Most marks, of a few bytes each, by which rows that a table does not need are kept out of a join.
MARKS = 1 << 18


def marked(rows: DataFrame, keys: DataFrame, key: str, inside: bool = True) -> DataFrame:
    """``rows`` whose ``key`` leaves a mark that one of ``keys`` leaves too (so all that are among them, and some
    others), or with ``inside`` false all the other rows.  At most ``MARKS`` marks are broadcast whatever the number
    of keys."""
    def mark(df):
        return F.pmod(F.xxhash64(df[key]), F.lit(MARKS))

    marks = keys.select(mark(keys).alias("mark")).distinct()
    return rows.join(F.broadcast(marks), mark(rows) == F.col("mark"), "left_semi" if inside else "left_anti")
