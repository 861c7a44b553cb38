"""Leaderboards, score and rank matrices."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Row and column order and labels of the report tables.
DATASETS = ["German Credit Card", "German Statlog", "Telco"]
TARGET_SCENARIOS = ["MAR_TARGET", "MCAR_TARGET", "MNAR_TARGET"]
ALL_SCENARIOS = ["MAR_TARGET", "MCAR_TARGET", "MNAR_TARGET", "MCAR_GLOBAL"]
RATES = [10, 15]
FAMILIES = ["classical", "llm_prompt", "llm_finetuned"]
METHODS = {
    "meanmode": "Mean/Mode",
    "medianmode": "Median/Mode",
    "mice": "MICE",
    "missforest": "MissForest",
    "dae": "DAE",
}
MODEL_ROWS = {
    "llm_prompt::llama": "Llama 3.1 Prompt",
    "llm_finetuned::llama": "Llama 3.1 Finetuned",
    "llm_prompt::mistral": "Mistral Prompt",
    "llm_finetuned::mistral": "Mistral Finetuned",
    "llm_prompt::qwen": "Qwen 2.5 Prompt",
    "llm_finetuned::qwen": "Qwen 2.5 Finetuned",
}
ALL_ROWS = {**METHODS, **MODEL_ROWS}
ROBUSTNESS_LABELS = {
    "MAR_TARGET": "MAR target-only",
    "MCAR_TARGET": "MCAR target-only",
    "MNAR_TARGET": "MNAR target-only",
    "MCAR_GLOBAL": "MCAR global",
}
SCENARIO_LABELS = {"MAR_TARGET": "MAR", "MCAR_TARGET": "MCAR", "MNAR_TARGET": "MNAR"}
MODELS = {"llama": "Llama 3.1", "mistral": "Mistral", "qwen": "Qwen 2.5"}


def _label(column: str, labels: Mapping[str, str]) -> Column:
    table = F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])
    return F.try_element_at(table, F.col(column))


def _place(column: str, order: Sequence[object]) -> Column:
    """0-based place in a fixed order; null when it is not listed."""
    spot = F.array_position(F.array(*[F.lit(o) for o in order]), F.col(column))
    return F.when(spot > 0, (spot - 1).cast("int"))


def _success(runs: DataFrame) -> DataFrame:
    return runs.where(F.col("status") == "success")


def comparison_rows(runs: DataFrame, seed: int = 42, rate: int = 10) -> DataFrame:
    """Successes of one seed and rate on the target scenarios, with their row key."""
    model = F.concat_ws("::", "method_family", "model_key")
    return _success(runs).where(
        (F.col("seed") == seed) & (F.col("rate_pct") == rate)
        & F.col("scenario_family").isin(TARGET_SCENARIOS)
        & F.col("method_family").isin(FAMILIES)).withColumn(
        "row_key", F.when(F.col("method_family") == "classical", F.col("method_key"))
        .otherwise(model))


def _model_rows(runs: DataFrame, rate: int = 10) -> DataFrame:
    return _success(runs).where(
        (F.col("rate_pct") == rate) & F.col("method_family").isin(FAMILIES[1:])
        & F.col("scenario_family").isin(TARGET_SCENARIOS)).withColumn(
        "row_key", F.concat_ws("::", "method_family", "model_key"))


def _classical_rows(runs: DataFrame) -> DataFrame:
    return _success(runs).where(F.col("method_family") == "classical").withColumn(
        "row_key", F.col("method_key"))


def _scores(rows: DataFrame, task: Sequence[str]) -> DataFrame:
    return rows.groupBy(*task, "row_key").agg(F.avg("mean_nrmse").alias("mean_nrmse_avg"))


def _ranked(scores: DataFrame, task: Sequence[str]) -> DataFrame:
    """Rank within a task (1 = lowest error, ties share the lower rank).

    A task has one row per method, so the window is small.
    """
    return scores.withColumn("rank", F.rank().over(
        Window.partitionBy(*task).orderBy("mean_nrmse_avg")))


def _matrix(
    scores: DataFrame, value: str, task: Sequence[str], tasks: Sequence[tuple],
    rows: Mapping[str, str],
) -> DataFrame:
    """One line per listed row in its order, one column per task; absent cells are null."""
    names = ["|".join(str(x) for x in t) for t in tasks]
    wide = (scores.withColumn("_task", F.concat_ws("|", *[F.col(c).cast("string") for c in task]))
            .groupBy("row_key").pivot("_task", names).agg(F.first(value)))
    listed = scores.sparkSession.createDataFrame(
        [(i, k, label) for i, (k, label) in enumerate(rows.items())],
        "row_order int, row_key string, method_label string")
    return F.broadcast(listed).join(wide, "row_key", "left").select(
        "row_order", "row_key", "method_label", *[F.col(f"`{n}`") for n in names]).orderBy(
        "row_order")


def _tasks(datasets: Sequence[str], scenarios: Sequence[str], rates: Sequence[int] | None = None):
    if rates is None:
        return [(d, s) for d in datasets for s in scenarios]
    return [(d, s, r) for d in datasets for s in scenarios for r in rates]


_TASK = ["dataset_name", "scenario_family"]
_RATED = [*_TASK, "rate_pct"]


def nrmse_matrix_all(runs: DataFrame, datasets: Sequence[str] = DATASETS) -> DataFrame:
    scores = _scores(comparison_rows(runs), _TASK)
    return _matrix(scores, "mean_nrmse_avg", _TASK, _tasks(datasets, TARGET_SCENARIOS), ALL_ROWS)


def rank_matrix_all(runs: DataFrame, datasets: Sequence[str] = DATASETS) -> DataFrame:
    scores = _ranked(_scores(comparison_rows(runs), _TASK), _TASK)
    return _matrix(scores, "rank", _TASK, _tasks(datasets, TARGET_SCENARIOS), ALL_ROWS)


def leaderboard(runs: DataFrame) -> DataFrame:
    """Mean and deviation of the error per method, best first."""
    return (comparison_rows(runs).groupBy("row_key").agg(
        F.avg("mean_nrmse").alias("mean_nrmse"), F.stddev_samp("mean_nrmse").alias("nrmse_std"),
        F.count(F.lit(1)).alias("n_tasks"))
        .withColumns({"method_label": _label("row_key", ALL_ROWS),
                      "plot_order": _place("row_key", list(ALL_ROWS))})
        .orderBy("mean_nrmse", "row_key"))


def nrmse_matrix_classical(runs: DataFrame, datasets: Sequence[str] = DATASETS) -> DataFrame:
    scores = _scores(_classical_rows(runs), _RATED)
    return _matrix(
        scores, "mean_nrmse_avg", _RATED, _tasks(datasets, ALL_SCENARIOS, RATES), METHODS)


def rank_matrix_classical(runs: DataFrame, datasets: Sequence[str] = DATASETS) -> DataFrame:
    scores = _ranked(_scores(_classical_rows(runs), _RATED), _RATED)
    return _matrix(scores, "rank", _RATED, _tasks(datasets, ALL_SCENARIOS, RATES), METHODS)


def rate_robustness(runs: DataFrame) -> DataFrame:
    """Mean error by scenario, rate and classical method, in report order."""
    rows = _success(runs).where(
        (F.col("method_family") == "classical") & F.col("scenario_family").isin(ALL_SCENARIOS)
        & F.col("rate_pct").isin(RATES))
    return (rows.groupBy("scenario_family", "rate_pct", "method_key")
            .agg(F.avg("mean_nrmse").alias("mean_nrmse_avg"))
            .withColumns({"scenario_label": _label("scenario_family", ROBUSTNESS_LABELS),
                          "method_label": _label("method_key", METHODS)})
            .orderBy(_place("scenario_family", ALL_SCENARIOS),
                     _place("method_key", list(METHODS)), "rate_pct"))


def runtime_vs_error(runs: DataFrame) -> DataFrame:
    """Runtime and error per classical method; a run without a runtime fails the job."""
    runtime = F.when(F.col("runtime_seconds").isNotNull(), F.col("runtime_seconds")).otherwise(
        F.raise_error(F.lit("A classical run has no runtime.")).cast("double"))
    return (_classical_rows(runs).withColumn("_t", runtime).groupBy("method_key").agg(
        F.avg("_t").alias("mean_runtime_seconds"), F.avg("mean_nrmse").alias("mean_nrmse"),
        F.stddev_samp("_t").alias("runtime_std_seconds"),
        F.stddev_samp("mean_nrmse").alias("nrmse_std"), F.count(F.lit(1)).alias("n_runs"))
        .withColumn("method_label", _label("method_key", METHODS))
        .orderBy(_place("method_key", list(METHODS))))


def scenario_robustness(runs: DataFrame, datasets: Sequence[str] = DATASETS) -> DataFrame:
    """Mean error of the fine-tuned models by data set and scenario."""
    rows = _success(runs).where(
        (F.col("method_family") == "llm_finetuned") & (F.col("rate_pct") == 10)
        & F.col("scenario_family").isin(TARGET_SCENARIOS) & F.col("dataset_name").isin(datasets))
    return (rows.groupBy("dataset_name", "scenario_family", "model_key")
            .agg(F.avg("mean_nrmse").alias("mean_nrmse_avg"))
            .withColumns({"scenario_label": _label("scenario_family", SCENARIO_LABELS),
                          "model_label": _label("model_key", MODELS)})
            .orderBy(_place("dataset_name", datasets), _place("model_key", list(MODELS)),
                     _place("scenario_family", TARGET_SCENARIOS)))


def nrmse_matrix_models(runs: DataFrame, datasets: Sequence[str] = DATASETS) -> DataFrame:
    scores = _scores(_model_rows(runs), _TASK)
    return _matrix(scores, "mean_nrmse_avg", _TASK, _tasks(datasets, TARGET_SCENARIOS), MODEL_ROWS)


def rank_matrix_models(runs: DataFrame, datasets: Sequence[str] = DATASETS) -> DataFrame:
    scores = _ranked(_scores(_model_rows(runs), _TASK), _TASK)
    return _matrix(scores, "rank", _TASK, _tasks(datasets, TARGET_SCENARIOS), MODEL_ROWS)
