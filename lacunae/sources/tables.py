"""Tables in and out: CSV, whitespace-separated text, scenarios, chat records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas

# The mechanisms scenario tables are filed under.
MECHANISMS = ("MAR", "MCAR", "MNAR")


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN is not a value here: every reader turns it into null."""
    floats = {f.name for f in df.schema if isinstance(f.dataType, T.DoubleType | T.FloatType)}
    return df.select(*[
        F.when(~F.isnan(c), F.col(c)).alias(c) if c in floats else F.col(c) for c in df.columns])


def read_table(spark: SparkSession, path: str | list[str], schema: T.StructType | str | None = None,
               multi_line: bool = False) -> DataFrame:
    """CSV with a header (declared schema, else all text) or Parquet.

    With `multi_line` quoted cells may hold line feeds; then a file is one task, whatever its size.
    """
    if isinstance(path, str) and path.rstrip("/").endswith(".parquet"):
        return nan_to_null(spark.read.parquet(path))
    reader = spark.read.option("header", True).option("escape", '"').option("multiLine", multi_line)
    return nan_to_null((reader.schema(schema) if schema else reader).csv(path))


def with_row_index(df: DataFrame, name: str = "row_index") -> DataFrame:
    """Consecutive 0-based row numbers in file order, for tables without a key.

    Rows are counted per partition; nothing is moved. Write the result before use,
    so the numbers stay with the rows.
    """
    local = df.withColumns({
        "_part": F.spark_partition_id(),
        "_at": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))})
    counts = sorted(local.groupBy("_part").count().collect())
    starts, total = [], 0
    for part, n in counts:
        starts.append((part, total))
        total += n
    table = F.broadcast(df.sparkSession.createDataFrame(starts, "_part int, _start long"))
    return local.join(table, "_part").select(
        (F.col("_start") + F.col("_at")).alias(name), *df.columns)


def parse_whitespace(lines: DataFrame, names: Sequence[str], kind: str = "int",
                     line: str = "value") -> DataFrame:
    """Columns of whitespace-separated numbers; other columns of the frame are kept."""
    parts = F.split(F.trim(F.col(line)), r"\s+")
    rest = [c for c in lines.columns if c != line]
    return lines.where(F.trim(F.col(line)) != "").select(
        *rest, *[F.get(parts, i).try_cast(kind).alias(n) for i, n in enumerate(names)])


def statlog_names(n: int = 25) -> list[str]:
    return [f"X{i}" for i in range(1, n)] + ["class"]


def read_whitespace(
    spark: SparkSession, path: str, names: Sequence[str] | None = None, kind: str = "int"
) -> DataFrame:
    return parse_whitespace(spark.read.text(path), names or statlog_names(), kind)


def rate_percent(rate: float) -> int:
    return int(round(rate * 100))


def write_scenario(df: DataFrame, root: str, mechanism: str, name: str, rate: float) -> None:
    """One partition per mechanism, scenario and rate; writing it again replaces it."""
    (df.withColumns({"mechanism": F.lit(mechanism), "scenario": F.lit(name),
                     "rate_pct": F.lit(rate_percent(rate))})
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("mechanism", "scenario", "rate_pct").parquet(root))


def read_scenario(
    spark: SparkSession, root: str, mechanism: str, name: str, rate: float
) -> DataFrame | None:
    """The scenario table, or None when it has not been written."""
    try:
        rows = spark.read.parquet(root)
    except AnalysisException:
        return None
    chosen = rows.where((F.col("mechanism") == mechanism) & (F.col("scenario") == name)
                        & (F.col("rate_pct") == rate_percent(rate)))
    return None if chosen.isEmpty() else chosen.drop("mechanism", "scenario", "rate_pct")


def list_scenarios(spark: SparkSession, root: str) -> DataFrame:
    """(mechanism, scenario, rate_pct, n_rows) of all written scenarios."""
    return (spark.read.parquet(root).groupBy("mechanism", "scenario", "rate_pct")
            .agg(F.count(F.lit(1)).alias("n_rows")))


def discover_scenarios(
    spark: SparkSession, root: str, mechanisms: Sequence[str] = MECHANISMS, glob: str = "*.csv"
) -> DataFrame:
    """(path, mechanism) of scenario files; the mechanism is the folder. Contents are not read."""
    try:
        files = (spark.read.format("binaryFile").option("pathGlobFilter", glob)
                 .load(f"{root}/{{{','.join(mechanisms)}}}"))
    except AnalysisException:
        return spark.createDataFrame([], "path string, mechanism string")
    return files.select(
        "path", F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("mechanism")).orderBy(
        F.array_position(F.array(*[F.lit(m) for m in mechanisms]), F.col("mechanism")), "path")


def chat_line(messages: Column) -> Column:
    return F.to_json(F.struct(messages.alias("messages")))


def write_chat_jsonl(df: DataFrame, path: str, messages: str = "messages") -> None:
    """One JSON record per line."""
    df.select(chat_line(F.col(messages)).alias("value")).write.mode("overwrite").text(path)


def read_chat_jsonl(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.CHAT_RECORD).json(path)
