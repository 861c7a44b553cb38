"""Experiment matrix and run tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from .evaluate import answer_metrics
from .order import number, salted_join

# What file-name tokens stand for, the settings of the shipped data
# sets, and the order in which result tables are sorted.
DATASETS = [
    # token, mark in a file name, key, name, target, MAR driver
    ("credit", "_credit_billamt1_", "creditcard", "German Credit Card", "BILL_AMT1", "PAY_0"),
    ("statlog", "_statlog_x2_", "statlog", "German Statlog", "X2", "X5"),
    ("telco", "_telco_totalcharges", "telco", "Telco", "TotalCharges", "tenure"),
]
MODELS = [
    ("qwen25", "qwen", "Qwen/Qwen2.5-7B-Instruct"),
    ("llama31", "llama", "meta-llama/Llama-3.1-8B-Instruct"),
    ("mistral", "mistral", "mistralai/Mistral-7B-Instruct-v0.3"),
]
SCENARIOS = [("mnar", "MNAR_TARGET", "MNAR"), ("mcar", "MCAR_TARGET", "MCAR"),
             ("mar", "MAR_TARGET", "MAR")]
EVAL_SUFFIX = "_finetuned_eval"
LOCATIONS = {
    "telco": {
        "MAR_TARGET": "MAR/telco_customer_churn_mar_totalcharges_tenure_{rate}pct.csv",
        "MNAR_TARGET": "MNAR/telco_customer_churn_mnar_totalcharges_{rate}pct.csv",
        "MCAR_TARGET": "MCAR/telco_customer_churn_mcar_totalcharges_{rate}pct.csv",
        "MCAR_GLOBAL": "MCAR/telco_customer_churn_mcar_{rate}pct.csv",
    },
    "statlog": {
        "MAR_TARGET": "MAR/german_statlog_numeric_mar_duration_creditamount_{rate}pct.csv",
        "MNAR_TARGET": "MNAR/german_statlog_numeric_mnar_duration_{rate}pct.csv",
        "MCAR_TARGET": "MCAR/german_statlog_numeric_mcar_duration_{rate}pct.csv",
        "MCAR_GLOBAL": "MCAR/german_statlog_numeric_mcar_{rate}pct.csv",
    },
    "creditcard": {
        "MAR_TARGET": "MAR/german_credit_mar_billamt1_pay0_{rate}pct.csv",
        "MNAR_TARGET": "MNAR/german_credit_mnar_billamt1_{rate}pct.csv",
        "MCAR_TARGET": "MCAR/german_credit_mcar_billamt1_{rate}pct.csv",
        "MCAR_GLOBAL": "MCAR/german_credit_mcar_{rate}pct.csv",
    },
}
AGGREGATE_BY = [
    "dataset_key", "dataset_name", "target_column", "scenario_family", "missingness_type",
    "mcar_scope", "rate_pct", "method_family", "method_key", "method_name", "model_key",
    "model_name"]
AGGREGATED = ["n_masked_target", "mean_rmse", "mean_nrmse", "runtime_seconds"]
PROMPT_SETTING = [
    "dataset_name", "target_column", "missingness_type", "method_key", "model_name"]
UNIFIED_ORDER = [
    "method_family", "dataset_key", "scenario_family", "rate_pct", "seed", "model_key",
    "run_timestamp_utc"]
FINETUNED_SOURCE = "llm_finetuned_eval_latest_timestamp"


def select_runs(
    manifest: DataFrame, method_family: str | None = "classical",
    distinct_on: Sequence[str] = (), **allowed: Sequence[object] | None,
) -> DataFrame:
    """Manifest rows of a method family, filtered by lists of allowed values (as text)."""
    rows = manifest if method_family is None else manifest.where(
        F.col("method_family") == method_family)
    for column, values in allowed.items():
        if values:
            rows = rows.where(F.col(column).cast("string").isin([str(v) for v in values]))
    return rows.dropDuplicates(list(distinct_on)) if distinct_on else rows


def resume(
    manifest: DataFrame, results: DataFrame, by: Sequence[str] = ("run_id",)
) -> DataFrame:
    """Manifest rows without a successful result."""
    done = results.where(F.col("status") == "success").select(*[
        F.col(c).cast("string").alias(f"_done_{c}") for c in by]).dropna().distinct()
    match = [F.col(c).cast("string") == F.col(f"_done_{c}") for c in by]
    return manifest.join(done, match, "left_anti")


def preview(rows: DataFrame, n: int = 30, order: Sequence[str] = ("run_id",)) -> DataFrame:
    if n < 1:
        raise ValueError("The limit must be at least 1.")
    return rows.orderBy(*order).limit(n)


def status_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("status").agg(F.count(F.lit(1)).alias("n_runs"))


def aggregate_runs(runs: DataFrame, by: Sequence[str] = AGGREGATE_BY) -> DataFrame:
    """Count, mean and sample deviation (0 for one run) of the successes per setting."""
    group = [c for c in by if c in runs.columns]
    if not group:
        raise ValueError("None of the grouping columns is there.")
    aggs = [F.count("run_id").alias("n_runs")]
    for c in AGGREGATED:
        aggs += [F.avg(c).alias(f"{c}_mean"),
                 F.coalesce(F.stddev_samp(c), F.lit(0.0)).alias(f"{c}_std")]
    # GROUP BY keeps null keys as a group of their own.
    return (runs.where(F.col("status") == "success").groupBy(*group).agg(*aggs)
            .orderBy(*[F.col(c).asc_nulls_last() for c in group]))


def _latest(rows: DataFrame, keys: Sequence[str], order: Column) -> DataFrame:
    """One row per key: the greatest by `order`, merged map-side."""
    columns = rows.columns
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*columns), order).alias("_row"))
    return best.select("_row.*")


def latest_prompt_runs(runs: DataFrame) -> DataFrame:
    """Latest success per prompt setting; a timestamp that cannot be read counts as oldest."""
    keys = PROMPT_SETTING + (["few_shot_k"] if "few_shot_k" in runs.columns else [])
    stamped = runs.where(F.col("status") == "success").withColumn(
        "_ts", F.try_to_timestamp(F.col("run_timestamp_utc").cast("string")))
    order = F.struct(F.col("_ts").isNotNull(), F.coalesce(F.col("_ts"), F.lit(0).cast("timestamp")),
                     F.col("run_id"))
    return _latest(stamped, keys, order).drop("_ts").orderBy(
        "dataset_key", "missingness_type", "model_key", "method_key")


def unify_sources(
    classical: Sequence[tuple[DataFrame, bool]], model: DataFrame | None = None,
    prompt: DataFrame | None = None,
) -> DataFrame:
    """One table of all runs, one row per run id and source group.

    `classical` lists (rows, canonical) in file order: a canonical source wins,
    otherwise the last one.
    """
    def ranked(df: DataFrame, place: int, canonical: bool) -> DataFrame:
        return df.withColumn("_rank", F.struct(F.lit(canonical), F.lit(place)))

    def shaped(df: DataFrame) -> DataFrame:
        return df.select(*[
            (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schemas.RUN])

    parts = []
    if classical:
        pile = None
        for place, (df, canonical) in enumerate(classical):
            part = ranked(shaped(df), place, canonical)
            pile = part if pile is None else pile.unionByName(part)
        parts.append(_latest(pile, ["run_id"], F.col("_rank")).drop("_rank"))
    if model is not None:
        parts.append(shaped(model))
    if prompt is not None:
        parts.append(_latest(shaped(prompt), ["run_id"], F.col("run_timestamp_utc")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.orderBy(*[F.col(c).asc_nulls_last() for c in UNIFIED_ORDER])


def _token(pairs: Sequence[tuple[str, str]], stem: Column, what: str) -> Column:
    out = None
    for token, mark in pairs:
        hit = stem.contains(mark)
        out = F.when(hit, F.lit(token)) if out is None else out.when(hit, F.lit(token))
    return out.otherwise(F.raise_error(F.concat(F.lit(f"No {what} in file name: "), stem)))


def parse_setting_name(path: Column) -> Column:
    """Struct (stem, dataset_token, model_token, scenario_token) of an evaluation file name.

    A name without a known part fails the job.
    """
    stem = F.regexp_replace(F.regexp_extract(path, r"([^/]+)$", 1), r"\.[^.]*$", "")
    checked = F.when(stem.endswith(EVAL_SUFFIX), stem).otherwise(
        F.raise_error(F.concat(F.lit("Not an evaluation file name: "), stem)))
    # mnar and mcar come first: both contain mar.
    scenarios = [(t, f"_{t}_lora{EVAL_SUFFIX}") for t, _, _ in SCENARIOS]
    return F.struct(
        checked.alias("stem"),
        _token([(d[0], d[1]) for d in DATASETS], stem, "dataset").alias("dataset_token"),
        _token([(m[0], f"_{m[0]}_") for m in MODELS], stem, "model").alias("model_token"),
        _token([*scenarios, ("mar", f"_totalcharges_lora{EVAL_SUFFIX}")], stem, "scenario")
        .alias("scenario_token"))


def latest_eval(detail: DataFrame, by: Sequence[str] = ("file",)) -> DataFrame:
    """Rows of the latest run (greatest timestamp text) per file with two numbers."""
    latest = detail.groupBy(*by).agg(F.max("run_timestamp_utc").alias("_latest"))
    kept = salted_join(detail, latest, list(by)).where(F.col("run_timestamp_utc") == F.col("_latest"))
    return kept.withColumns({
        "prediction": number(F.col("prediction").try_cast("double")),
        "ground_truth": number(F.col("ground_truth").try_cast("double"))}).where(
        F.col("prediction").isNotNull() & F.col("ground_truth").isNotNull()).drop("_latest")


def _lookup(spark: SparkSession) -> tuple[DataFrame, DataFrame, DataFrame]:
    datasets = spark.createDataFrame(
        [(d[0], d[2], d[3], d[4], d[5]) for d in DATASETS],
        "dataset_token string, dataset_key string, dataset_name string, target_column string, "
        "_driver string")
    models = spark.createDataFrame(
        [(m[0], m[1]) for m in MODELS], "model_token string, model_key string")
    scenarios = spark.createDataFrame(
        SCENARIOS, "scenario_token string, scenario_family string, missingness_type string")
    return tuple(F.broadcast(t) for t in (datasets, models, scenarios))


def summary_from_detail(detail: DataFrame, file: str = "file") -> DataFrame:
    """One run row per evaluation file, scored on its latest run."""
    latest = latest_eval(detail, [file])
    scored = answer_metrics(latest, [file, "run_timestamp_utc"])
    names = latest.groupBy(file).agg(F.max("model_name").alias("model_name"))
    datasets, models, scenarios = _lookup(detail.sparkSession)
    named = scored.join(names, file).withColumn("_p", parse_setting_name(F.col(file)))
    named = named.select("*", "_p.*").drop("_p")
    wide = (named.join(datasets, "dataset_token").join(models, "model_token")
            .join(scenarios, "scenario_token"))
    values = {
        "run_id": F.concat_ws("::", F.lit("inferred"), "stem", "run_timestamp_utc"),
        "mcar_scope": F.lit("target"), "rate_pct": F.lit(10), "seed": F.lit(42),
        "method_family": F.lit("llm_finetuned"), "method_key": F.lit("llm_finetuned"),
        "method_name": F.lit("LLM Finetuned"), "status": F.lit("success"),
        "n_masked_target": F.col("n_valid"), "source_file": F.col(file),
        "source_type": F.lit(FINETUNED_SOURCE),
        "provenance_note": F.lit("Scored on the latest run in the evaluation rows.")}
    return wide.select(*[
        values.get(f.name, F.col(f.name) if f.name in wide.columns else F.lit(None))
        .cast(f.dataType).alias(f.name) for f in schemas.RUN])


def derive_manifest(runs: DataFrame, drivers: DataFrame | None = None) -> DataFrame:
    """Manifest rows of finished runs; driver columns follow from the scenario.

    `drivers` holds dataset_key, mar_driver and mnar_driver (default: the shipped sets).
    """
    if drivers is None:
        drivers = runs.sparkSession.createDataFrame(
            [(d[2], d[5], d[4]) for d in DATASETS],
            "dataset_key string, mar_driver string, mnar_driver string")
    wide = runs.join(F.broadcast(drivers), "dataset_key", "left")
    values = {
        "mar_dependency_column": F.when(
            F.col("scenario_family") == "MAR_TARGET", F.col("mar_driver")),
        "mnar_driver_column": F.when(
            F.col("scenario_family") == "MNAR_TARGET", F.col("mnar_driver")),
        "include_in_primary_leaderboard": F.lit(True),
        "include_in_secondary_full_matrix": F.lit(False)}
    return wide.select(*[
        values.get(f.name, F.col(f.name) if f.name in wide.columns else F.lit(None))
        .cast(f.dataType).alias(f.name) for f in schemas.MANIFEST])


def check_primary_key(runs: DataFrame, key: Sequence[str] = schemas.RUN_KEY) -> DataFrame:
    """Keys that occur more than once (null is a value of its own)."""
    return runs.groupBy(*key).agg(F.count(F.lit(1)).alias("n_rows")).where("n_rows > 1")


def check_completeness(
    expected: DataFrame, runs: DataFrame, key: Sequence[str]
) -> DataFrame:
    """Expected combinations without a run."""
    have = runs.select(*[F.col(c).alias(f"_have_{c}") for c in key]).distinct()
    match = [F.col(c).eqNullSafe(F.col(f"_have_{c}")) for c in key]
    return expected.join(have, match, "left_anti")


def scenario_grid(
    spark: SparkSession, datasets: Sequence[str], families: Sequence[str], rates: Sequence[int]
) -> DataFrame:
    """Every scenario slot, e.g. 3 data sets x 4 families x 2 rates."""
    return spark.createDataFrame(
        [(d, f, r) for d in datasets for f in families for r in rates],
        "dataset_key string, scenario_family string, rate_pct int")


def check_metrics(runs: DataFrame) -> DataFrame:
    """Missing scores among the successes; model runs also need a fallback rate."""
    ok = runs.where(F.col("status") == "success")
    needs_rate = F.col("method_family") != "classical"
    return ok.agg(
        F.count(F.lit(1)).alias("n_success"),
        F.count_if(F.col("mean_rmse").isNull()).alias("no_rmse"),
        F.count_if(F.col("mean_nrmse").isNull()).alias("no_nrmse"),
        F.count_if(needs_rate & F.col("fallback_rate").isNull()).alias("no_fallback_rate"))


def check_mask_scope(
    pair: DataFrame, columns: Sequence[str], allowed: Sequence[str],
    truth: str = "truth__", holed: str = "holed__",
) -> DataFrame:
    """Columns with new holes outside the allowed ones (joined frame of full and holed)."""
    cells = F.array(*[
        F.struct(F.lit(c).alias("column_name"),
                 (F.col(truth + c).isNotNull() & F.col(holed + c).isNull()).alias("new_hole"))
        for c in columns if c not in allowed])
    return (pair.select(F.inline(cells)).groupBy("column_name")
            .agg(F.count_if("new_hole").alias("n_new_holes")).where("n_new_holes > 0"))


def scenario_location(dataset: Column, family: Column, rate: Column) -> Column:
    """Place of a scenario table; an unknown data set or family fails the job."""
    out = None
    for d, families in LOCATIONS.items():
        for f, template in families.items():
            head, tail = template.split("{rate}")
            hit = (dataset == d) & (family == f)
            path = F.concat(F.lit(head), rate.cast("string"), F.lit(tail))
            out = F.when(hit, path) if out is None else out.when(hit, path)
    return out.otherwise(F.raise_error(F.concat_ws(
        " ", F.lit("No scenario location for"), dataset, family)))


def method_labels(k: Column) -> Column:
    """Struct (method_key, method_name, prompt_token) of a prompt run with k examples."""
    n = k.cast("string")
    zero = k == 0
    return F.struct(
        F.when(zero, F.lit("llm_prompt_zero"))
        .otherwise(F.concat(F.lit("llm_prompt_fewshot_k"), n)).alias("method_key"),
        F.when(zero, F.lit("LLM Prompt Zero-shot"))
        .otherwise(F.concat(F.lit("LLM Prompt Few-shot k="), n)).alias("method_name"),
        F.when(zero, F.lit("zero")).otherwise(F.concat(F.lit("few"), n)).alias("prompt_token"))


def prompt_run_id(
    dataset: Column, model: Column, scenario: Column, k: Column, timestamp: Column
) -> Column:
    return F.concat_ws("::", F.lit("prompt"), dataset, model, scenario,
                       F.concat(F.lit("k"), k.cast("string")), timestamp)
