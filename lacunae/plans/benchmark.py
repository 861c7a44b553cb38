"""Run a manifest, log results, cross-validate."""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor, as_completed
from datetime import UTC, datetime

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions import texts
from ..operators import evaluate, folds
from ..operators.registry import IMPUTERS, build_imputer
from ..operators.runs import resume
from ..session import scratch_path, scratch_root, store
from ..sources.results import RESULT_TABLES, commit_results, read_results, read_runs, write_run

Loader = Callable[[str, str, int], tuple[DataFrame, DataFrame, list[str]] | None]


def run_one(
    full: DataFrame, holed: DataFrame, keys: Sequence[str], target: str, method: str, seed: int,
    **options,
) -> dict[str, object]:
    """Impute one scenario and score its target."""
    filled = build_imputer(method, seed, keys, **options).fit_transform(holed)
    return evaluate.checked_target_score(
        evaluate.side_by_side(full, holed, filled, keys, [target]), target)


def run_matrix(
    spark: SparkSession, manifest: DataFrame, load: Loader, skip_missing: bool = True,
    fail_fast: bool = False, options: Mapping[str, Mapping[str, object]] | None = None,
    order: Sequence[str] = ("run_id",), path: str | None = None, side_by_side: int = 4,
) -> DataFrame:
    """One run row per manifest row, read back from the run table at `path`.

    The manifest is a short list of experiments and each is a distributed job of its own; `side_by_side` of them
    run at once, each in its scheduler pool. A finished row is on disk before the next experiment begins, in the
    partition of its `run_id`, so a table at `path` survives the driver: runs that it has with success are not
    repeated, others replace their rows. With `fail_fast` the row of the failure is written before it is raised.
    """
    options = options or {}
    scratch_root(spark)  # before experiments ask for it at once
    path = path or scratch_path(spark, "runs")
    # Only settings come to the driver, not results.
    todo = resume(manifest, read_runs(spark, path)).orderBy(*order).collect()

    def experiment(setting) -> None:
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", str(setting["run_id"]))
        started = time.perf_counter()
        row = {name: (setting[name] if name in setting else None)
               for name in schemas.CLASSICAL_RUN.fieldNames()}
        method = setting["method_key"]
        row["method_family"] = "classical"
        row["method_name"] = row["method_name"] or getattr(IMPUTERS.get(method), "name", method)
        place = (setting["dataset_key"], setting["scenario_family"], setting["rate_pct"])
        failure: Exception | None = None
        try:
            tables = load(*place)
            if tables is None:
                message = "Missing scenario: " + "/".join(str(p) for p in place)
                row.update(status="missing_file", error_message=message)
                failure = None if skip_missing else FileNotFoundError(message)
            else:
                score = run_one(*tables, setting["target_column"], method, setting["seed"],
                                **options.get(method, {}))
                row.update(status="success", n_masked_target=score["n_masked_target"],
                           mean_rmse=score["mean_rmse"], mean_nrmse=score["mean_nrmse"])
        except Exception as problem:
            row.update(status="error", error_message=str(problem))
            failure = problem if fail_fast else None
        row["run_timestamp_utc"] = datetime.now(UTC).isoformat()
        row["runtime_seconds"] = time.perf_counter() - started
        write_run(spark, row, path)
        if failure:
            raise failure

    with ThreadPoolExecutor(max_workers=max(1, side_by_side)) as pool:
        waiting = [pool.submit(inheritable_thread_target(spark)(experiment), setting) for setting in todo]
        try:
            for done in as_completed(waiting):
                done.result()
        except BaseException:
            for other in waiting:
                other.cancel()
            raise
    mine = manifest.select(F.col("run_id").alias("_mine")).distinct()
    return read_runs(spark, path).join(mine, F.col("run_id") == F.col("_mine"), "left_semi")


def result_tables(
    pair: DataFrame, keys: Sequence[str], columns: Sequence[str], run: Mapping[str, object],
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(detail rows, RMSE table row, NRMSE table row); no scored cell is an error.

    `run` holds dataset, missingness_type, missing_rate and imputation_method.
    """
    stamped = {"run_timestamp_utc": datetime.now(UTC).isoformat(), **run}
    detail = evaluate.detail_rows(pair, keys, columns, stamped)
    if detail.isEmpty():
        raise ValueError("There is no masked cell to log.")
    scores = evaluate.mean_over_columns(evaluate.column_scores(pair, columns))
    fields = ("dataset", "missingness_type", "missing_rate", "imputation_method")
    named = scores.select(*[F.lit(run[f]).alias(f) for f in fields], "mean_rmse", "mean_nrmse")
    return detail, named.drop("mean_nrmse"), named.drop("mean_rmse")


def log_result(
    pair: DataFrame, keys: Sequence[str], columns: Sequence[str], run: Mapping[str, object],
    root: str | None = None, run_id: str | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three tables of a run (see `result_tables`), appended under `root` if that is given.

    The same run again replaces its rows and adds nothing. What is returned is then read from disk.
    """
    tables = result_tables(pair, keys, columns, run)
    if root is None:
        return tables
    run_id = run_id or "|".join(str(run[f]) for f in (
        "dataset", "missingness_type", "missing_rate", "imputation_method"))
    commit_results(dict(zip(RESULT_TABLES, tables)), root, run_id)
    here = F.col("run_id") == run_id
    return tuple(read_results(pair.sparkSession, root, name).where(here).drop("run_id") for name in RESULT_TABLES)


def cross_validate(
    df: DataFrame, target: str, keys: Sequence[str], method: str = "mice", k: int = 5,
    seed: int = 42, requested_bins: int = 10, **options,
) -> tuple[DataFrame, DataFrame]:
    """(pooled answers of all folds, split manifest) of an imputer on the known rows.

    In each fold the target is hidden there and the imputer is fitted on the rest.
    """
    known = df.where(F.col(target).isNotNull())
    # Kept once: the medians, every fold's fit and answers, and the manifest read it.
    split = store(folds.stratified_kfold(known, target, keys, k, seed, requested_bins), *keys)
    medians = folds.fold_train_median(split, target, "fold_id", k)
    pooled = None
    for fold in range(1, k + 1):
        here = F.col("fold_id") == fold
        work = split.withColumn(target, F.when(~here, F.col(target))).drop("bin", "fold_id")
        model = build_imputer(method, seed, keys, **options).fit(work)
        answers = model.transform(work).select(*keys, F.col(target).alias("_answer"))
        tested = split.where(here).select(*keys, "fold_id", F.col(target).alias("ground_truth"))
        part = tested.join(answers, list(keys))
        pooled = part if pooled is None else pooled.unionByName(part)
    answer = F.col("_answer").cast("double")
    out = pooled.join(F.broadcast(medians), "fold_id").select(
        *keys, "fold_id", F.coalesce(answer, F.col("train_median")).alias("prediction"),
        F.col("ground_truth").cast("double").alias("ground_truth"),
        F.when(answer.isNotNull(), F.lit(texts.FIRST_TRY))
        .otherwise(F.lit(texts.TRAIN_MEDIAN_SOURCE)).alias("source"))
    total = split.count()
    manifest = split.groupBy("fold_id").agg(F.count(F.lit(1)).alias("cv_test_size")).withColumns({
        "cv_train_size": F.lit(total) - F.col("cv_test_size"), "cv_folds": F.lit(k)})
    return out, manifest
