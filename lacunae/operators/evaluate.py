"""Scores of filled cells against the truth.

Every function works on one frame that carries truth, holed and filled values
side by side (`side_by_side` joins three keyed tables into that form).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import texts
from .order import number, running_totals

EPSILON = 1e-8
TRUTH, HOLED, FILLED = "truth__", "holed__", "filled__"


def side_by_side(
    full: DataFrame, holed: DataFrame, filled: DataFrame, keys: Sequence[str],
    columns: Sequence[str],
) -> DataFrame:
    """Key columns plus truth__c, holed__c, filled__c."""
    def tagged(df: DataFrame, tag: str) -> DataFrame:
        return df.select(*keys, *[F.col(c).alias(tag + c) for c in columns])

    return (tagged(full, TRUTH).join(tagged(holed, HOLED), list(keys))
            .join(tagged(filled, FILLED), list(keys)))


def with_truth(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Complete table that also carries truth__c through everything that follows.

    With `with_holes` after the injection and `as_filled` after the imputation the
    three values stand side by side without a join; name the carried columns as
    keys of the imputer (`carried`), so that it does not look at them.
    """
    return df.withColumns({TRUTH + c: F.col(c) for c in columns})


def with_holes(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({HOLED + c: F.col(c) for c in columns})


def as_filled(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumnsRenamed({c: FILLED + c for c in columns})


def carried(columns: Sequence[str]) -> list[str]:
    return [tag + c for tag in (TRUTH, HOLED) for c in columns]


def _cell(c: str) -> tuple[Column, Column, Column]:
    return number(TRUTH + c), number(HOLED + c), number(FILLED + c)


def _norm(value: Column, kind: str) -> Column:
    if kind == "std":
        return F.stddev_pop(value)
    if kind == "range":
        return F.max(value) - F.min(value)
    raise ValueError("The norm must be 'std' or 'range'.")


def column_scores(df: DataFrame, columns: Sequence[str], norm: str = "std") -> DataFrame:
    """(column_name, n_masked, n_unfilled, rmse, nrmse) in one pass.

    rmse counts cells that are holes with a known truth; nrmse divides by the
    spread of the true values in the holes.
    """
    aggs = []
    for i, c in enumerate(columns):
        truth, holed, filled = _cell(c)
        hole = holed.isNull()
        known = hole & truth.isNotNull()
        error = F.when(known, truth - filled)
        aggs += [
            F.count_if(known).alias(f"n{i}"),
            F.count_if(known & filled.isNull()).alias(f"u{i}"),
            F.sqrt(F.avg(error * error)).alias(f"r{i}"),
            _norm(F.when(hole, truth), norm).alias(f"d{i}")]
    row = df.agg(*aggs)
    cells = F.array(*[
        F.struct(
            F.lit(c).alias("column_name"), F.col(f"n{i}").alias("n_masked"),
            F.col(f"u{i}").alias("n_unfilled"), F.col(f"r{i}").alias("rmse"),
            (F.col(f"r{i}") / (F.col(f"d{i}") + F.lit(EPSILON))).alias("nrmse"))
        for i, c in enumerate(columns)])
    return row.select(F.inline(cells))


def rmse(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return column_scores(df, columns).select("column_name", "rmse")


def nrmse(df: DataFrame, columns: Sequence[str], norm: str = "std") -> DataFrame:
    return column_scores(df, columns, norm).select("column_name", "nrmse")


def mean_over_columns(scores: DataFrame) -> DataFrame:
    """Mean of the column scores; columns without holes are skipped."""
    return scores.agg(F.avg("rmse").alias("mean_rmse"), F.avg("nrmse").alias("mean_nrmse"))


def evaluate_target(df: DataFrame, target: str, norm: str = "std") -> DataFrame:
    """mean_rmse, mean_nrmse, n_masked_target and n_unfilled of one column."""
    return column_scores(df, [target], norm).select(
        F.col("rmse").alias("mean_rmse"), F.col("nrmse").alias("mean_nrmse"),
        F.col("n_masked").alias("n_masked_target"), "n_unfilled")


def checked_target_score(df: DataFrame, target: str) -> dict[str, object]:
    """`evaluate_target` as a dict; fails when there is nothing to score."""
    score = evaluate_target(df, target).first().asDict()
    if not score["n_masked_target"]:
        raise ValueError(f"No masked cell of '{target}' has a known truth.")
    return score


def detail_rows(
    df: DataFrame, keys: Sequence[str], columns: Sequence[str],
    run: Mapping[str, object] | None = None, source: str = "tabular_imputer",
) -> DataFrame:
    """One row per scored cell: key, column, prediction, truth, error and the run fields."""
    cells = F.array(*[
        F.struct(
            F.lit(c).alias("column_name"), number(FILLED + c).alias("prediction"),
            number(TRUTH + c).alias("ground_truth"),
            (number(HOLED + c).isNull() & number(TRUTH + c).isNotNull()).alias("_hole"))
        for c in columns])
    long = df.select(*keys, F.inline(cells)).where("_hole")
    return long.select(
        *[F.lit(v).alias(k) for k, v in (run or {}).items()], *keys, "column_name",
        "prediction", "ground_truth",
        F.abs(F.col("prediction") - F.col("ground_truth")).alias("abs_error"),
        F.lit(source).alias("source"))


def answer_metrics(detail: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Scores of model answers on rows with a prediction and a truth.

    Any answer that is not the model's first one, in whichever plan, counts as a fallback.
    """
    p, t = number("prediction"), number("ground_truth")
    valid = detail.where(p.isNotNull() & t.isNotNull())
    out = valid.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_valid"),
        F.sqrt(F.avg((t - p) * (t - p))).alias("mean_rmse"),
        F.stddev_pop(t).alias("_std"),
        F.avg((~F.coalesce(F.col("source").isin(*texts.FIRST_ANSWERS), F.lit(False))).cast("double"))
        .alias("fallback_rate"))
    return out.select(
        *by, "n_valid", "mean_rmse",
        (F.col("mean_rmse") / (F.col("_std") + F.lit(EPSILON))).alias("mean_nrmse"),
        "fallback_rate")


def nrmse_full_population(detail: DataFrame, full: DataFrame, target: str) -> DataFrame:
    """RMSE of the answers over the spread of the whole observed target."""
    spread = full.agg(F.stddev_pop(number(target)).alias("_std"))
    return answer_metrics(detail).crossJoin(F.broadcast(spread)).select(
        "n_valid", "mean_rmse",
        (F.col("mean_rmse") / (F.col("_std") + F.lit(EPSILON))).alias("mean_nrmse"))


def source_counts(detail: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return detail.groupBy(*by, "source").agg(F.count(F.lit(1)).alias("n_rows"))


def running_mae(
    detail: DataFrame, by: Sequence[str], order: Sequence[str], **options
) -> DataFrame:
    """Mean absolute error of all rows so far; rows without an error do not count."""
    out = running_totals(
        detail, by, order,
        {"_sum": F.coalesce(F.col("abs_error"), F.lit(0.0)),
         "_seen": F.col("abs_error").isNotNull().cast("long")}, **options)
    return out.withColumn(
        "running_mae", F.when(F.col("_seen") > 0, F.col("_sum") / F.col("_seen"))
    ).drop("_sum", "_seen")
