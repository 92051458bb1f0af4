"""Scans and sinks.

Text tables arrive all-string on purpose: types are decided afterwards from the
values (``operators.infer``).  Parquet and JSON keep the reader's types.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.predicates import is_date, is_numeric, is_string
from pyspark.sql import types as T

TEXT_OPTIONS = {
    "header": "true",
    "inferSchema": "false",   # every column string; promotion is value-driven
    "mode": "PERMISSIVE",     # malformed rows become nulls instead of failing
    "multiLine": "false",     # files split at lines; pass multiLine="true" where quoted fields span lines
    "escape": '"',
    "encoding": "UTF-8",      # invalid bytes decode to U+FFFD (lossy)
}


def read_csv(spark: SparkSession, path: str, sep: str = ",", **options) -> DataFrame:
    opts = dict(TEXT_OPTIONS, sep=sep)
    opts.update(options)
    return spark.read.options(**opts).csv(path)


def read_tsv(spark: SparkSession, path: str, **options) -> DataFrame:
    return read_csv(spark, path, sep="\t", **options)


def read_json(spark: SparkSession, path: str, **options) -> DataFrame:
    """JSON lines, which split, or an array of records, which one task reads
    whole: the first line with text says which, unless ``multiLine`` does."""
    if "multiLine" not in options:
        first = spark.read.text(path).where(F.trim("value") != "").first()
        options["multiLine"] = str(first is not None and first[0].lstrip().startswith("[")).lower()
    return spark.read.options(**options).json(path)


def read_parquet(spark: SparkSession, path: str, min_partitions: int | None = None) -> DataFrame:
    """Parquet scan.  ``min_partitions``: when the scan plans fewer splits than
    this (a few large single-row-group files), spread the rows round-robin so
    later passes run in parallel.  Large inputs already have many splits and
    are left untouched."""
    df = spark.read.parquet(path)
    if min_partitions:
        return with_parallelism(df, min_partitions)
    return df


def with_parallelism(df: DataFrame, min_partitions: int) -> DataFrame:
    """Round-robin repartition only when the plan has fewer partitions than
    ``min_partitions`` (partition count comes from split planning, no job).

    That only happens for small inputs (a file of one row group is one
    task).  Catalyst pushes filters and column pruning through the
    repartition, so the scan still reads only what the query needs."""
    if df.rdd.getNumPartitions() >= min_partitions:
        return df
    return df.repartition(min_partitions)


READERS = {
    ".csv": read_csv,
    ".tsv": read_tsv,
    ".txt": read_tsv,
    ".json": read_json,
    ".parquet": read_parquet,
}


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """Dispatch on the file suffix; anything else is an error."""
    ext = os.path.splitext(path.rstrip("/"))[1].lower()
    reader = READERS.get(ext)
    if reader is None:
        raise ValueError(f"Unsupported file type: {ext or path}")
    return reader(spark, path)


def load_dataset(spark: SparkSession, paths: dict[str, str]) -> dict[str, DataFrame]:
    """Named tables; the first name is the default one (``default_name``)."""
    return {name: read_table(spark, p) for name, p in paths.items()}


def default_name(dataset: dict[str, DataFrame]) -> str:
    return next(iter(dataset))


def kind_of(dtype: T.DataType) -> str:
    if isinstance(dtype, T.BooleanType):
        return "boolean"
    if is_numeric(dtype):
        return "numeric"
    if is_date(dtype):
        return "date"
    if is_string(dtype):
        return "categorical"
    return "other"


def overview(df: DataFrame) -> DataFrame:
    """(column, position, dtype, kind) for every column: a driver-side
    description of the schema, no scan."""
    spark = df.sparkSession
    rows = [(f.name, i, f.dataType.simpleString(), kind_of(f.dataType)) for i, f in enumerate(df.schema.fields)]
    return spark.createDataFrame(rows, "column string, position int, dtype string, kind string")


def table_summary(df: DataFrame) -> DataFrame:
    """One row: rows, columns and the bytes of the files the frame reads.
    File sources group by ``_metadata.file_path`` (one partial row per file),
    other sources report null bytes."""
    n_cols = len(df.columns)
    try:
        per_file = df.groupBy(F.col("_metadata.file_path").alias("_f")).agg(
            F.count(F.lit(1)).alias("_n"), F.max("_metadata.file_size").alias("_b"))
        return per_file.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("rows"),
                            F.lit(n_cols).alias("cols"), F.sum("_b").alias("file_bytes"))
    except Exception:  # not a file source
        return df.agg(F.count(F.lit(1)).alias("rows"), F.lit(n_cols).alias("cols"),
                      F.lit(None).cast("bigint").alias("file_bytes"))


def write_csv(df: DataFrame, path: str, quote_all: bool = False, mode: str = "overwrite", sep: str = ",") -> None:
    """CSV sink of a version (A7); ``quote_all`` for the searched-view export.
    Written in parallel, one file per partition."""
    (df.write.mode(mode).option("header", "true").option("quoteAll", str(quote_all).lower())
       .option("escape", '"').option("sep", sep).csv(path))
