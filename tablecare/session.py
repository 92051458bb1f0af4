"""Session helpers: a tuned local session for tests/bench, and the shared
checkpoint folder the cluster names in ``spark.checkpoint.dir``."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_spark(master: str = "local[*]", shuffle_partitions: int = 8, app: str = "tablecare") -> SparkSession:
    """Session for tests and the bench.  On a cluster, build your own session;
    nothing in the library depends on these settings."""
    spark = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder.  Uses the one the cluster configured;
    only when none is set (local tests) a scratch folder is created."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
        configured = tempfile.mkdtemp(prefix="tablecare-ckpt-")  # local runs and tests only
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def pinned(df: DataFrame) -> DataFrame:
    """``df`` computed once and written as Parquet into the shared checkpoint
    folder, so that every branch of a later plan reads the same rows, and of
    them only the columns it needs.  Columns go by number: their names may be
    anything.  Types that Parquet doesn't hold are checkpointed as they are."""
    spark = df.sparkSession
    if any(kind in df.schema.simpleString() for kind in ("void", "interval", "struct<>", "variant")):
        checkpoint_dir(spark)
        return df.checkpoint()
    numbered = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    path = scratch_path(spark, "pinned")
    numbered.write.parquet(path)
    return spark.read.schema(numbered.schema).parquet(path).toDF(*df.columns)


def scratch_path(spark: SparkSession, kind: str, suffix: str = "") -> str:
    """A new folder's path in the shared checkpoint folder; what is written
    there goes when the application ends."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/tablecare-{kind}-{uuid.uuid4().hex}{suffix}"
    hadoop_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop_path)
    return path
