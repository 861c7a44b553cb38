"""Result tables: append, replace a part, one table per setting."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas

# Run-level scores that do not belong into detail tables.
SUMMARY_ONLY = ("mean_rmse", "mean_nrmse", "rmse")
RESULT_TABLES = ("detail", "rmse", "nrmse")


def append_union(
    existing: DataFrame, new: DataFrame, required: Sequence[str] | None = None
) -> DataFrame:
    """Rows of both; a column that one side lacks is null there; existing order first."""
    both = existing.unionByName(new, allowMissingColumns=True)
    if required is None:
        return both
    return both.select(*[
        F.col(c) if c in both.columns else F.lit(None).cast("string").alias(c) for c in required])


def append_rows(rows: DataFrame, path: str) -> None:
    """Append to a stored table; readers merge the schemas."""
    rows.drop(*SUMMARY_ONLY).write.mode("append").parquet(path)


def replace_slice(
    table: DataFrame, rows: DataFrame, prefix: str, column: str = "imputation_method"
) -> DataFrame:
    """Table without the rows whose method starts with the prefix, plus the new rows."""
    keep = ~F.coalesce(F.col(column).cast("string").startswith(prefix), F.lit(False))
    return append_union(table.where(keep), rows, table.columns)


def file_token(value: Column, lower: bool = True) -> Column:
    """Text that is safe in a file name."""
    token = F.regexp_replace(value.cast("string"), "[^A-Za-z0-9._-]+", "_")
    token = F.regexp_replace(token, "^_+|_+$", "")
    token = F.lower(token) if lower else token
    return F.when(token != "", token).otherwise(F.lit("unknown"))


def setting_path(dataset: Column, mechanism: Column, method: Column, model: Column) -> Column:
    """Name of the detail table of one setting; the model part only when there is one."""
    named = F.when(F.trim(model) != "", file_token(model))
    return F.concat(
        F.concat_ws("__", file_token(dataset), file_token(mechanism), file_token(method), named),
        F.lit(".csv"))


def write_settings(detail: DataFrame, path: str) -> None:
    """All settings at once, one partition each; a repeated setting replaces its partition."""
    setting = setting_path(F.col("dataset"), F.col("missingness_type"),
                           F.col("imputation_method"), F.col("model_name"))
    (detail.withColumn("setting", setting).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("setting").parquet(path))


def _replace_partition(rows: DataFrame, path: str) -> None:
    """Rows of one run into its partition; what the partition held goes in the same commit."""
    (rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("run_id").parquet(path))


def write_run(spark: SparkSession, row: Mapping[str, object], path: str) -> None:
    """One run row into the run table; a repeated run replaces its row."""
    names = schemas.CLASSICAL_RUN.fieldNames()
    rows = spark.createDataFrame([tuple(row[n] for n in names)], schemas.CLASSICAL_RUN)
    _replace_partition(rows.coalesce(1), path)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """All rows of a run table; none if there is no table yet."""
    try:
        return spark.read.schema(schemas.CLASSICAL_RUN).parquet(path).select(*schemas.CLASSICAL_RUN.fieldNames())
    except AnalysisException:
        return spark.createDataFrame([], schemas.CLASSICAL_RUN)


def commit_results(tables: Mapping[str, DataFrame], root: str, run_id: str) -> None:
    """Replace the rows of one run in several tables under `root`.

    Each table is a partition overwrite, and a marker comes last: readers see a run when all its tables are there.
    A call that was cut off leaves no visible run, and the next one replaces what it left.
    """
    spark = next(iter(tables.values())).sparkSession
    for name, rows in tables.items():
        _replace_partition(rows.withColumn("run_id", F.lit(run_id)), f"{root}/{name}")
    _replace_partition(spark.createDataFrame([(run_id, True)], "run_id string, whole boolean"), f"{root}/committed")


def read_results(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A table under `root` with the rows of all committed runs, `run_id` last."""
    whole = spark.read.parquet(f"{root}/committed").select(F.col("run_id").cast("string").alias("_run"))
    rows = spark.read.option("mergeSchema", "true").parquet(f"{root}/{name}")
    rows = rows.withColumn("run_id", F.col("run_id").cast("string"))
    return rows.join(whole, F.col("run_id") == F.col("_run"), "left_semi")
