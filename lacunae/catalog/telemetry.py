"""Power samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.hashing import row_unit
from ..operators import telemetry
from .fixtures import load, sql_unit

_KEYS = ["event_id"]


def _micros(spark, sf):
    """Events with their time as whole microseconds, whatever the session's time zone."""
    events = load(spark, sf, "events")
    ts = F.unix_micros(F.to_timestamp(F.col("ts").cast("timestamp_ntz").cast("string")))
    return events.select("event_id", "user_id", "value", ts.alias("micros"))


def _sample_lines(spark, sf):
    """Sampling tool output with both timestamp forms and some unusable lines."""
    u = row_unit(2, _KEYS, "line")
    stamp = F.timestamp_micros("micros")
    short = F.date_format(stamp, "yyyy/MM/dd HH:mm:ss")
    long = F.date_format(stamp, "yyyy/MM/dd HH:mm:ss.SSS")
    rest = F.concat(F.lit(", "), F.col("value").cast("string"), F.lit(", "),
                    (F.col("event_id") % 100).cast("string"), F.lit(", 1024"))
    return _micros(spark, sf).select(
        "event_id",
        F.when(u < 0.05, F.lit("timestamp, power.draw [W]"))
        .when(u < 0.1, F.concat(short, F.lit(", n/a, 1, 2")))
        .when(u < 0.15, F.concat(F.lit("yesterday"), rest))
        .when(u < 0.5, F.concat(short, rest)).otherwise(F.concat(long, rest)).alias("value"))


def k1_read_samples(spark, sf):
    return telemetry.parse_samples(_sample_lines(spark, sf)).select(
        "event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSS").alias("ts"), "power_w",
        "utilisation_pct", "memory_mib")


def _samples(spark, sf):
    return _micros(spark, sf).select(
        "event_id", "user_id", F.timestamp_micros("micros").alias("ts"),
        F.col("value").alias("power_w"), (F.col("event_id") % 100).cast("double")
        .alias("utilisation_pct"), (F.col("event_id") % 4096).cast("double").alias("memory_mib"))


_ORDER = ["ts", "event_id"]


def k2_integrate_trapezoid(spark, sf):
    return telemetry.integrate_trapezoid(_samples(spark, sf), ["user_id"], _ORDER).withColumn(
        "energy_wh", F.round("energy_wh", 6))


def k2_integrate_one_series(spark, sf):
    return telemetry.integrate_trapezoid(_samples(spark, sf), [], _ORDER).withColumn(
        "energy_wh", F.round("energy_wh", 4))


def k3_telemetry_summary(spark, sf):
    out = telemetry.telemetry_summary(_samples(spark, sf), ["user_id"], _ORDER, rounded=False)
    # A mean of two-digit values may lie halfway between two roundings, so nine digits are kept.
    return out.withColumns({c: F.round(c, 6 if c == "gpu_energy_wh" else 9)
                            for c, t in out.dtypes if t == "double"})


QUERIES = {f.__name__: f for f in (
    k1_read_samples, k2_integrate_trapezoid, k2_integrate_one_series, k3_telemetry_summary)}

_STEPS = """s AS (SELECT *, epoch_us(ts) AS us FROM events),
  steps AS (SELECT *, (us - lag(us) OVER w) / 1e6::DOUBLE AS seconds, lag(value) OVER w AS before
    FROM s WINDOW w AS ({partition} ORDER BY us, event_id)),
  energy AS (SELECT {series} count(*) AS n_samples, coalesce(sum(CASE WHEN seconds > 0
    THEN (before + value) / 2 * seconds END), 0) / 3600 AS energy_wh FROM steps {group})"""
_BY_USER = _STEPS.format(
    partition="PARTITION BY user_id", series="user_id,", group="GROUP BY user_id")
_U = sql_unit(2, _KEYS, "line")

SQL = {
    "k1_read_samples": f"""WITH u AS (SELECT *, {_U} AS u FROM events)
  SELECT event_id, strftime(CASE WHEN u < 0.5 THEN date_trunc('second', ts) ELSE ts END,
    '%Y-%m-%d %H:%M:%S.%g') AS ts, value AS power_w,
    (event_id % 100)::DOUBLE AS utilisation_pct, 1024::DOUBLE AS memory_mib
  FROM u WHERE u >= 0.15""",
    "k2_integrate_trapezoid": f"""WITH {_BY_USER} SELECT user_id, n_samples,
  round(energy_wh, 6) AS energy_wh FROM energy""",
    "k2_integrate_one_series": f"""WITH {_STEPS.format(partition="", series="", group="")}
  SELECT n_samples, round(energy_wh, 4) AS energy_wh FROM energy""",
    "k3_telemetry_summary": f"""WITH {_BY_USER}, t AS (SELECT user_id,
    round((max(us) - min(us)) / 1e6::DOUBLE, 9) AS duration_seconds,
    round(avg(value), 9) AS mean_gpu_power_w, round(max(value), 9) AS peak_gpu_power_w,
    round(avg((event_id % 100)::DOUBLE), 9) AS mean_gpu_utilization_pct,
    max(event_id % 4096)::DOUBLE AS peak_gpu_memory_mib FROM s GROUP BY 1)
  SELECT user_id, n_samples, duration_seconds, round(energy_wh, 6) AS gpu_energy_wh,
    mean_gpu_power_w, peak_gpu_power_w, mean_gpu_utilization_pct, peak_gpu_memory_mib
  FROM energy JOIN t USING (user_id) WHERE n_samples >= 2""",
}
