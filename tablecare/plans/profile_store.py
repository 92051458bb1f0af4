"""A profile kept per input file (J15), so that changed files cost only themselves.

``ProfileStore`` holds one row per file and column: counts, the first three
power sums about the file's own mean, minimum, maximum, and two mergeable
sketches (distinct values, quantiles).  Files are told apart by path, length
and time of modification.  ``update`` reads the files that the store doesn't
know and appends their rows; ``profile`` merges the rows of the files asked
for.  A dropped file needs no reading at all, a replaced one only itself.

Counts, moments, minimum and maximum of the merged profile are those of one
pass over all files; ``distinct_approx`` and ``median_approx`` come from the
sketches (relative error about 1 %, and rank error below 1 %).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..functions import predicates as P

_NUMBERS = ("n", "mean", "m2", "m3", "min", "max", "sum")
STATE = ("file string, length bigint, modified bigint, column string, position int, dtype string, rows bigint, nulls bigint, "
         "missing bigint, empty bigint, n bigint, mean double, m2 double, m3 double, min double, max double, sum double, "
         "distinct_sketch binary, quantile_sketch binary")


def files_under(spark: SparkSession, path: str, suffix: str = ".parquet") -> list[tuple[str, int, int]]:
    """(path, length, time of modification) of the files below ``path``, by the names that Spark gives them."""
    jvm = spark.sparkContext._jvm
    top = jvm.org.apache.hadoop.fs.Path(path)
    found, out = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(top, True), []
    while found.hasNext():
        f = found.next()
        name = f.getPath().getName()
        if name.endswith(suffix) and not name.startswith(("_", ".")):
            out.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return sorted(out)


def stat(spark: SparkSession, path: str) -> tuple[str, int, int]:
    """(path, length, time of modification) of a file."""
    f = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    s = f.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(f)
    return path, s.getLen(), s.getModificationTime()


def file_states(df: DataFrame, file: str, tokens=P.MISSING_TOKENS, chunk: int = 30) -> DataFrame:
    """One row per file and column of ``df``, whose column ``file`` names each row's file: partial aggregates only."""
    schema = [f for f in df.schema.fields if f.name != file]
    out = None
    for start in range(0, len(schema), chunk):
        part = schema[start:start + chunk]
        aggs, items = [F.count(F.lit(1)).alias("rows")], []
        for i, f in enumerate(part):
            x = F.col(P.quoted(f.name))
            aggs += [F.count_if(x.isNull()).alias(f"{i}_nulls"), F.count_if(P.is_missing(f.name, f.dataType, tokens)).alias(f"{i}_missing"),
                     F.count_if(P.is_empty(f.name, f.dataType)).alias(f"{i}_empty"),
                     F.hll_sketch_agg(x.cast("string"), 12).alias(f"{i}_distinct")]
            numeric = P.is_numeric(f.dataType)
            if numeric:
                v = F.when(~F.isnan(x.cast("double")), x.cast("double") + F.lit(0.0))
                aggs += [F.count(v).alias(f"{i}_n"), F.avg(v).alias(f"{i}_mean"), F.var_pop(v).alias(f"{i}_var"), F.skewness(v).alias(f"{i}_skew"),
                         F.min(v).alias(f"{i}_min"), F.max(v).alias(f"{i}_max"), F.sum(v).alias(f"{i}_sum"),
                         F.kll_sketch_agg_double(v, F.lit(400)).alias(f"{i}_q")]
            n, var = F.col(f"{i}_n"), F.col(f"{i}_var")
            numbers = {"n": n, "mean": F.col(f"{i}_mean"), "m2": var * n,
                       "m3": F.coalesce(F.col(f"{i}_skew"), F.lit(0.0)) * n * F.pow(var, 1.5),
                       "min": F.col(f"{i}_min"), "max": F.col(f"{i}_max"), "sum": F.col(f"{i}_sum")} if numeric else {}
            items.append(F.struct(
                F.lit(f.name).alias("column"), F.lit(start + i).alias("position"), F.lit(f.dataType.simpleString()).alias("dtype"),
                F.col("rows"), *[F.col(f"{i}_{k}").alias(k) for k in ("nulls", "missing", "empty")],
                *[(numbers[k] if numeric else F.lit(None)).cast("bigint" if k == "n" else "double").alias(k) for k in _NUMBERS],
                F.col(f"{i}_distinct").alias("distinct_sketch"),
                (F.col(f"{i}_q") if numeric else F.lit(None).cast("binary")).alias("quantile_sketch")))
        rows = df.groupBy(F.col(P.quoted(file)).alias("file")).agg(*aggs).select("file", F.inline(F.array(*items)))
        out = rows if out is None else out.unionByName(rows)
    return out


def merged(states: DataFrame) -> DataFrame:
    """One row per column from rows of ``STATE``: the profile of all their files."""
    n = F.col("n")
    base = states.groupBy("column", "position", "dtype").agg(
        *[F.sum(c).alias(c) for c in ("rows", "nulls", "missing", "empty", "n", "sum")], F.min("min").alias("min"), F.max("max").alias("max"),
        F.try_divide(F.sum(n * F.col("mean")), F.sum(n)).alias("mean"),
        F.hll_sketch_estimate(F.hll_union_agg("distinct_sketch")).alias("distinct_approx"),
        F.kll_merge_agg_double("quantile_sketch").alias("_q"))
    # power sums about the common mean, from those about each file's own
    away = F.col("mean") - F.col("_m")
    moved = (states.where("n > 0").join(base.select(F.col("column"), F.col("mean").alias("_m")), "column").groupBy("column").agg(
        F.sum(F.col("m2") + n * away * away).alias("_m2"),
        F.sum(F.col("m3") + 3 * away * F.col("m2") + n * away * away * away).alias("_m3")))
    t = base.join(moved, "column", "left")
    std = F.when(n > 1, F.sqrt(F.col("_m2") / (n - 1)))
    skew = F.when(F.col("_m2") > 0, F.sqrt(n.cast("double")) * F.col("_m3") / F.pow(F.col("_m2"), 1.5))
    median = F.when(n > 0, F.kll_sketch_get_quantile_double("_q", F.lit(0.5)))
    return t.select("column", "position", "dtype", "rows", "nulls", "missing", "empty", (F.col("rows") - F.col("missing") - F.col("empty")).alias("valid"),
                    "n", "mean", std.alias("std"), "min", "max", "sum", skew.alias("skew"), "distinct_approx", median.alias("median_approx"))


class ProfileStore:
    """Rows of ``STATE`` under ``folder`` (shared storage, any file system Spark knows)."""

    def __init__(self, spark: SparkSession, folder: str, read: Callable | None = None):
        self.spark, self.folder = spark, folder
        self.read = read or (lambda files: spark.read.parquet(*files))

    def states(self) -> DataFrame:
        jvm, sc = self.spark.sparkContext._jvm, self.spark.sparkContext
        path = jvm.org.apache.hadoop.fs.Path(self.folder)
        if not path.getFileSystem(sc._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], STATE)
        return self.spark.read.schema(STATE).parquet(self.folder)

    def _listed(self, files: list[tuple[str, int, int]]) -> DataFrame:
        return self.spark.createDataFrame(files, "file string, length bigint, modified bigint")

    def update(self, files: list[tuple[str, int, int]]) -> list[str]:
        """Reads those of ``files`` that the store doesn't hold as they are now, and returns their paths."""
        keys = ["file", "length", "modified"]
        new = [r.file for r in self._listed(files).join(self.states().select(*keys).distinct(), keys, "left_anti").collect()]
        if new:
            df = self.read(sorted(new))
            rows = file_states(df.select(*[F.col(P.quoted(c)) for c in df.columns], F.col("_metadata.file_path").alias("__file")), "__file")
            # a file without rows has a row of no column, so that it is known
            listed = self._listed([f for f in files if f[0] in set(new)])
            local = F.regexp_replace("file", "^file:/+", "file:/")
            rows = rows.withColumn("file", local)
            kept = listed.withColumn("_f", local).join(rows.withColumnRenamed("file", "_f"), "_f", "left")
            kept.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in T._parse_datatype_string(STATE).fields]).write.mode("append").parquet(self.folder)
        return sorted(new)

    def profile(self, files: list[tuple[str, int, int]]) -> DataFrame:
        """The profile of ``files`` together; those that changed or are new are read first."""
        self.update(files)
        held = self.states().join(F.broadcast(self._listed(files)) if len(files) < 100_000 else self._listed(files), ["file", "length", "modified"])
        return merged(held.where("column IS NOT NULL").dropDuplicates(["file", "length", "modified", "column"]))
