"""Fitted imputers on streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery


def read_stream(
    spark: SparkSession, path: str, schema: T.StructType, name_filter: str | None = None
) -> DataFrame:
    """Parquet files of a folder as they arrive."""
    reader = spark.readStream.schema(schema)
    if name_filter:
        reader = reader.option("pathGlobFilter", name_filter)
    return reader.parquet(path)


def fill_stream(
    stream: DataFrame, model, output: str, checkpoint: str, once: bool = True
) -> StreamingQuery:
    """Write the filled rows of a stream; the transform is stateless.

    With `once`, everything that is there is processed and the query ends.
    """
    writer = (model.transform(stream).writeStream.format("parquet").outputMode("append")
              .option("checkpointLocation", checkpoint).option("path", output))
    return (writer.trigger(availableNow=True) if once else writer).start()
