"""Session settings and the shared scratch folder."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Adaptive execution splits skewed shuffle partitions of sort-merge joins even when that
# costs one more exchange; everything that aggregates or ranks inside one key handles hot
# keys itself (see operators/groups.py).
ENGINE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    # sessions of a hot user are merged before the shuffle
    "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the engine's runtime settings to a session the caller owns."""
    for key, value in ENGINE_CONF.items():
        spark.conf.set(key, value)
    return spark


def build_session(cpus: int = 8, shuffle_partitions: int = 8, memory: str = "16g") -> SparkSession:
    """Local session for tests and the benchmark, with a scratch folder that ends with the process.

    Clusters bring their own session and name a shared folder in spark.checkpoint.dir.
    """
    scratch = tempfile.TemporaryDirectory(prefix="formulake-", ignore_cleanup_errors=True)
    atexit.register(scratch.cleanup)
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("formulake")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", memory)
        .config("spark.checkpoint.dir", scratch.name)
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return tune(spark)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt over all cores by hash: a small file has one row group, which one task would read and work on."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism, *keys)


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as the session names it in spark.checkpoint.dir.

    A session on a local master that names none gets one for its own use.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    scratch = tempfile.TemporaryDirectory(prefix="formulake-", ignore_cleanup_errors=True)
    atexit.register(scratch.cleanup)
    spark.conf.set("spark.checkpoint.dir", scratch.name)
    return scratch.name


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder; nothing is ever overwritten."""
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write a table once and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.scratch_path = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete the files of tables that ``materialise`` wrote; nothing may read them any more."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table.scratch_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
