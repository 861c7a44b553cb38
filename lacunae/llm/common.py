"""Small helpers shared by the operators of this package."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Iterable, Iterator
from contextlib import AbstractContextManager, contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from lacunae.session import scratch_path

DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
LONGEST_METHOD = "spark.sql.codegen.hugeMethodLimit"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared scratch folder and read back: the lineage ends there."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables of `stored` that no later plan reads."""
    for df in tables:
        jvm = df.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(df.scratch)
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


@contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """Within, a setting of the session has this value."""
    known = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        if known is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, known)


def shuffles_dropped(spark: SparkSession) -> AbstractContextManager[None]:
    """Within, Spark deletes the shuffle files of a write when it ends: nothing runs on them again."""
    return setting(spark, DROP_SHUFFLES, "true")


def methods_split(spark: SparkSession) -> AbstractContextManager[None]:
    """Within, steps whose code would be one method too long for the JVM to compile become methods of their own."""
    return setting(spark, LONGEST_METHOD, "8000")


def settled(df: DataFrame, name: str) -> DataFrame:
    """As `stored`, and the shuffle files go with the end of the write."""
    with shuffles_dropped(df.sparkSession):
        return stored(df, name)


def stored_by(df: DataFrame, name: str, key: str) -> DataFrame:
    """Write to the shared scratch folder in buckets of `key`: joins on it need no shuffle of this side."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    table = f"scratch_{path.rsplit('-', 1)[-1]}"
    with shuffles_dropped(spark), methods_split(spark):
        df.write.bucketBy(shuffle_tasks(spark), key).sortBy(key).option("path", path).option(
            "compression", "zstd").saveAsTable(table)
    return spark.table(table)


def shuffle_tasks(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def slices(batches: Iterable[pa.RecordBatch], column: str,
           max_bytes: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that one slice holds about `max_bytes` of a text column (one row at least)."""
    for batch in batches:
        size = max(1, batch.column(batch.schema.get_field_index(column)).nbytes)
        step = max(1, int(batch.num_rows * max_bytes / size))
        for start in range(0, batch.num_rows, step):
            yield batch.slice(start, step)
        pa.default_memory_pool().release_unused()


def kept(name: str, make: Callable[[], object]) -> object:
    """An object that later tasks of the same Python worker find again, such as a loaded vocabulary.

    The functions of this library reach a worker anew with each task, and so would their globals.
    """
    store = sys.modules.setdefault("_kept_by_worker", types.ModuleType("_kept_by_worker")).__dict__
    if name not in store:
        store[name] = make()
    return store[name]
