"""Power samples to energy."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .order import BUCKET_ROWS, order_buckets

# Timestamp format of the sampling tool, field order of its file.
TIMESTAMP_FORMAT = "yyyy/MM/dd HH:mm:ss[.SSSSSS]"
FIELDS = ("power_w", "utilisation_pct", "memory_mib")


def parse_samples(df: DataFrame, line: str = "value") -> DataFrame:
    """ts, power_w, utilisation_pct, memory_mib; lines of another shape are left out."""
    parts = F.split(F.col(line), ",", -1)
    stamp = F.trim(F.get(parts, 0))
    ts = F.try_to_timestamp(stamp, F.lit(TIMESTAMP_FORMAT))
    numbers = {name: F.trim(F.get(parts, i + 1)).try_cast("double")
               for i, name in enumerate(FIELDS)}
    out = df.where(F.size(parts) == 4).withColumns({"ts": ts, **numbers})
    keep = F.col("ts").isNotNull()
    for name in FIELDS:
        keep = keep & F.col(name).isNotNull()
    return out.where(keep).drop(line)


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    return parse_samples(spark.read.text(path))


def integrate_trapezoid(
    df: DataFrame, series: Sequence[str], order: Sequence[str] = ("ts",),
    power: str = "power_w", bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """energy_wh per series; steps that do not move forward in time add nothing.

    A long series is cut into time buckets: each bucket is summed on its own, and
    its first sample is paired with the last sample of the bucket before.
    """
    work = df.withColumns({"_s": F.unix_micros("ts"), "_p": F.col(power).cast("double")})
    order = [("_s" if c == "ts" else c) for c in order]
    work = order_buckets(work, order, df.count(), bucket_rows)
    inner = Window.partitionBy(*series, "_b").orderBy(*order)
    seconds = (F.col("_s") - F.lag("_s").over(inner)) / F.lit(1e6)
    area = F.when(seconds > 0, (F.col("_p") + F.lag("_p").over(inner)) / 2 * seconds)
    edge = F.struct(*order)
    point = F.struct("_s", "_p")
    buckets = (
        work.select(*series, "_b", edge.alias("_edge"), point.alias("_point"),
                    area.alias("_area"))
        .groupBy(*series, "_b").agg(
            F.sum("_area").alias("_area"), F.count(F.lit(1)).alias("_n"),
            F.min_by("_point", "_edge").alias("_first"),
            F.max_by("_point", "_edge").alias("_last")))
    across = Window.partitionBy(*series).orderBy("_b")
    last = F.lag("_last").over(across)
    gap = (F.col("_first._s") - last["_s"]) / F.lit(1e6)
    bridge = F.when(gap > 0, (F.col("_first._p") + last["_p"]) / 2 * gap)
    return (
        buckets.select(*series, "_n", (F.coalesce(F.col("_area"), F.lit(0.0))
                                       + F.coalesce(bridge, F.lit(0.0))).alias("_area"))
        .groupBy(*series).agg(F.sum("_n").alias("n_samples"),
                              (F.sum("_area") / 3600).alias("energy_wh")))


def energy_wh(df: DataFrame, **options) -> float:
    """Energy of one series; fewer than two samples fail."""
    row = integrate_trapezoid(df, [], **options).first()
    if row is None or (row["n_samples"] or 0) < 2:
        raise ValueError("At least two valid samples are needed.")
    return row["energy_wh"]


def telemetry_summary(
    df: DataFrame, series: Sequence[str], order: Sequence[str] = ("ts",),
    bucket_rows: int = BUCKET_ROWS, rounded: bool = True,
) -> DataFrame:
    """Count, duration, energy, mean and peak power, mean utilisation, peak memory per series."""
    energy = integrate_trapezoid(df, series, order, bucket_rows=bucket_rows).drop("n_samples")
    micros = F.unix_micros("ts")
    stats = df.groupBy(*series).agg(
        F.count(F.lit(1)).alias("n_samples"),
        ((F.max(micros) - F.min(micros)) / F.lit(1e6)).alias("duration_seconds"),
        F.avg("power_w").alias("mean_gpu_power_w"), F.max("power_w").alias("peak_gpu_power_w"),
        F.avg("utilisation_pct").alias("mean_gpu_utilization_pct"),
        F.max("memory_mib").alias("peak_gpu_memory_mib"))
    joined = stats.join(energy, list(series)) if series else stats.crossJoin(energy)
    digits = {
        "duration_seconds": 3, "gpu_energy_wh": 4, "mean_gpu_power_w": 3, "peak_gpu_power_w": 3,
        "mean_gpu_utilization_pct": 3, "peak_gpu_memory_mib": 3}
    out = joined.where(F.col("n_samples") >= 2).withColumnRenamed("energy_wh", "gpu_energy_wh")
    return out.select(*series, "n_samples", *[
        F.round(c, d).alias(c) if rounded else F.col(c) for c, d in digits.items()])
