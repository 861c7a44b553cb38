"""Ordinal codes for text columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .order import salted_join

MAP_LIMIT = 2_000


def category_codes(df: DataFrame, column: str) -> DataFrame:
    """(value, code): codes follow the sorted order of the distinct non-null values.

    Values are dealt by ranges and sorted there; the code is the place in the range plus the sizes of those before.
    Ties cannot be hot, because every value is there once.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    values = df.select(F.col(column).alias("value")).where(F.col(column).isNotNull()).distinct()
    # The number of a row: its range in the upper bits, its place there in the lower 33.
    ranged = cut_lineage(values.repartitionByRange(parts, "value").sortWithinPartitions("value").select(
        "value", F.monotonically_increasing_id().alias("_row")))
    part = F.shiftright("_row", 33)
    sizes = sorted(ranged.groupBy(part.alias("part")).count().collect())  # one row per range
    starts, before = [], 0
    for r in sizes:
        starts.append((r["part"], before))
        before += r["count"]
    table = F.broadcast(spark.createDataFrame(starts, "_part long, _before long"))
    place = F.col("_row") - F.shiftleft(F.col("_part"), 33)
    return ranged.withColumn("_part", part).join(table, "_part").select(
        "value", (F.col("_before") + place).cast("double").alias("code"))


def category_lists(
    df: DataFrame, columns: Sequence[str], limit: int | None = MAP_LIMIT
) -> dict[str, list[str] | None]:
    """Sorted categories per column in one pass; None for a column with more than `limit`."""
    if not columns:
        return {}
    cells = F.array(*[
        F.struct(F.lit(i).alias("c"), F.col(c).alias("v")) for i, c in enumerate(columns)])
    values = df.select(F.inline(cells)).where(F.col("v").isNotNull()).distinct()
    sizes = {r["c"]: r["count"] for r in values.groupBy("c").count().collect()}
    long = [i for i, n in sizes.items() if limit is not None and n > limit]
    found: dict[str, list[str] | None] = {
        c: None if i in long else [] for i, c in enumerate(columns)}
    for row in values.where(~F.col("c").isin(long) if long else F.lit(True)).collect():
        found[columns[row["c"]]].append(row["v"])
    # UTF-8 order, the order in which Spark and SQL sort text.
    return {c: v and sorted(v, key=lambda x: x.encode()) for c, v in found.items()}


def category_list(df: DataFrame, column: str) -> list[str]:
    """Sorted categories of one column, as literals; `category_codes` is the table for very many."""
    return category_lists(df, [column], limit=None)[column] or []


def encode(column: str, categories: Sequence[str]) -> Column:
    """Code of a text value; an unknown value is -1, null stays null."""
    place = F.array_position(F.array(*[F.lit(c) for c in categories]), F.col(column))
    return (place - 1).cast("double")


def decode(code: Column, categories: Sequence[str]) -> Column:
    """Label of the nearest code, clipped to the known codes."""
    place = F.greatest(F.least(F.rint(code), F.lit(float(len(categories) - 1))), F.lit(0.0))
    return F.element_at(F.array(*[F.lit(c) for c in categories]), place.cast("int") + 1)


def encode_by_join(df: DataFrame, column: str, codes: DataFrame, name: str) -> DataFrame:
    """As `encode` for any number of categories, hot ones included."""
    table = codes.select(F.col("value").alias(column), F.col("code").alias("_code"))
    joined = salted_join(df, table, [column], "left")
    code = F.when(F.col(column).isNotNull(), F.coalesce(F.col("_code"), F.lit(-1.0)))
    return joined.select(*df.columns, code.alias(name))


def decode_by_join(df: DataFrame, code: str, codes: DataFrame, n: int, name: str) -> DataFrame:
    """As `decode` for any number of categories."""
    place = F.greatest(F.least(F.rint(F.col(code)), F.lit(float(n - 1))), F.lit(0.0))
    table = codes.select(F.col("code").alias("_place"), F.col("value").alias("_label"))
    joined = salted_join(df.withColumn("_place", place), table, ["_place"], "left")
    return joined.select(*df.columns, F.col("_label").alias(name))
