"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def local_session(name: str = "lacunae", cpus: str | int = "*") -> SparkSession:
    """Session for tests and the bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("LACUNAE_DRIVER_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def scratch_root(spark: SparkSession) -> str:
    """Shared folder named by the cluster; a fresh temporary one only in local mode."""
    configured = spark.conf.get(CHECKPOINT_CONF, None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"Set {CHECKPOINT_CONF} to a folder that all executors share.")
    folder = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    spark.conf.set(CHECKPOINT_CONF, folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """New path for a written intermediate table."""
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame, *spread_by: str) -> DataFrame:
    """Reliable checkpoint: the result survives the loss of executors.

    With `spread_by`, a result in fewer partitions than there are cores is spread by
    these columns, for algorithms that read it many times.
    """
    spark = df.sparkSession
    root = scratch_root(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(root)
    stored = df.checkpoint(eager=True)
    if spread_by:
        wide = spread(stored, *spread_by)
        if wide is not stored:
            return wide.checkpoint(eager=True)
    return stored


def store(df: DataFrame, *spread_by: str) -> DataFrame:
    """The same for wide tables: written column by column, a fraction of a checkpoint's bytes; order and partitioning go."""
    spark = df.sparkSession

    def written(part: DataFrame) -> DataFrame:
        path = scratch_path(spark, "table")
        part.write.option("compression", "zstd").parquet(path)
        return spark.read.schema(part.schema).parquet(path)

    stored = written(df)
    if spread_by:
        wide = spread(stored, *spread_by)
        if wide is not stored:
            return written(wide)
    return stored


def spread(scan: DataFrame, *keys: str) -> DataFrame:
    """Use all cores on a scan (a file or checkpoint) that has fewer splits than cores.

    Larger inputs are left as they are: they already have a task per split.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    if scan.rdd.getNumPartitions() >= cores:
        return scan
    return scan.repartition(cores, *keys)
