"""Experiment matrix, run tables and reports, on runs computed from the orders.

Every order is a row of one of three data sets; each scenario empties a share of
the totals; each method answers with the truth times a hashed error of its own
size. Scoring these answers gives the run rows that the queries work on.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.hashing import hex_unit, row_unit
from ..operators import evaluate, inject, reports, runs
from ..plans.benchmark import run_matrix
from ..session import scratch_path
from .fixtures import ORDER_KEYS, orders, sql_hex, sql_slice, sql_unit

_DATASETS = {"F": ("orders_f", "Orders F"), "O": ("orders_o", "Orders O"),
             "P": ("orders_p", "Orders P")}
_NAMES = [name for _, name in _DATASETS.values()]
_FAMILIES = ["MAR_TARGET", "MNAR_TARGET", "MCAR_TARGET", "MCAR_GLOBAL"]
_SCENARIOS = [(f, r) for f in _FAMILIES for r in (10, 15)]
# family, method key, method name, model key, seed, error size
_METHODS = [
    ("classical", key, name, None, seed, size + seed / 10000)
    for key, name, size in (("meanmode", "Mean/Mode", 1.2), ("medianmode", "Median/Mode", 1.3),
                            ("mice", "MICE", 0.5), ("missforest", "MissForest", 0.3),
                            ("dae", "DAE", 0.45)) for seed in (42, 202)
] + [
    (family, key, name, model, 42, size)
    for family, key, name, sizes in (
        ("llm_prompt", "llm_prompt_fewshot_k2", "LLM Prompt Few-shot k=2", (0.8, 0.7, 0.6)),
        ("llm_finetuned", "llm_finetuned", "LLM Finetuned", (0.4, 0.42, 0.38)))
    for model, size in zip(("llama", "mistral", "qwen"), sizes)
]


def _pick(table: dict, column: str, place: int):
    out = None
    for key, values in table.items():
        hit = F.col(column) == key
        out = F.when(hit, F.lit(values[place])) if out is None else out.when(hit, values[place])
    return out


def _detail(spark, sf):
    """One answer per emptied total, scenario and method."""
    scenarios = F.array(*[
        F.when(row_unit(42, ORDER_KEYS, f"{f}:{r}") < F.lit(r / 100),
               F.struct(F.lit(f).alias("scenario_family"), F.lit(r).alias("rate_pct")))
        for f, r in _SCENARIOS])
    holes = orders(spark, sf).select(
        "o_orderkey", "o_totalprice", _pick(_DATASETS, "o_orderstatus", 0).alias("dataset_key"),
        _pick(_DATASETS, "o_orderstatus", 1).alias("dataset_name"),
        F.inline(F.array_compact(scenarios)))
    methods = F.array(*[
        F.struct(F.lit(f).alias("method_family"), F.lit(k).alias("method_key"),
                 F.lit(n).alias("method_name"), F.lit(m).cast("string").alias("model_key"),
                 F.lit(s).alias("seed"), F.lit(float(z)).alias("size"))
        for f, k, n, m, s, z in _METHODS])
    model = F.col("method_family") != "classical"
    wide = holes.select("*", F.inline(methods)).where(
        ~model | ((F.col("rate_pct") == 10) & (F.col("scenario_family") != "MCAR_GLOBAL")))
    digits = F.md5(F.concat_ws(
        ":", F.col("o_orderkey").cast("string"), "scenario_family", F.col("rate_pct").cast("string"),
        "method_family", "method_key", "model_key", F.col("seed").cast("string")))
    wide = wide.withColumn("_digits", digits)
    return wide.withColumns({
        "prediction": F.col("o_totalprice") * (
            1 + F.col("size") * (hex_unit(F.col("_digits")) - 0.5)),
        "ground_truth": F.col("o_totalprice"),
        "source": F.when(hex_unit(F.col("_digits"), 14) < 0.9, F.lit("model_first_try"))
        .otherwise(F.lit("model_retry"))}).drop("_digits", "size")


_RUN_BY = ["dataset_key", "dataset_name", "scenario_family", "rate_pct", "seed", "method_family",
           "method_key", "method_name", "model_key"]


def _runs(spark, sf):
    """Scored runs; a hash of the run id makes one in sixteen a failure."""
    scored = evaluate.answer_metrics(_detail(spark, sf), _RUN_BY)
    run_id = F.concat_ws(
        "::", "method_family", "dataset_key", "scenario_family", F.col("rate_pct").cast("string"),
        F.col("seed").cast("string"), "method_key", "model_key")
    model = F.col("method_family") != "classical"
    return scored.select(
        run_id.alias("run_id"), *_RUN_BY, F.lit("o_totalprice").alias("target_column"),
        F.split("scenario_family", "_")[0].alias("missingness_type"),
        F.lower(F.split("scenario_family", "_")[1]).alias("mcar_scope"),
        F.when(model, F.concat(F.lit("model/"), "model_key")).alias("model_name"),
        F.when(F.substring(F.md5(run_id), 1, 1) == "0", F.lit("error"))
        .otherwise(F.lit("success")).alias("status"),
        F.col("n_valid").alias("n_masked_target"), "mean_rmse", "mean_nrmse",
        (F.col("n_valid") / 1000).alias("runtime_seconds"),
        F.when(model, F.col("fallback_rate")).alias("fallback_rate"))


def _all_good(spark, sf):
    return _runs(spark, sf).withColumn("status", F.lit("success"))


def i1_select_runs(spark, sf):
    chosen = runs.select_runs(
        _runs(spark, sf), "classical", dataset_key=["orders_f", "orders_o"],
        method_key=["mice", "dae"], rate_pct=["10"], seed=[42])
    return chosen.select("run_id", "dataset_key", "method_key", "rate_pct", "seed")


def i1_prompt_settings(spark, sf):
    keys = ["dataset_name", "target_column", "missingness_type", "model_key", "model_name"]
    return runs.select_runs(
        _runs(spark, sf), "llm_prompt", keys, model_key=["qwen", "llama"]).select(*keys)


def i2_resume(spark, sf):
    table = _runs(spark, sf)
    return runs.resume(table.select("run_id", "method_key"), table)


def i2_resume_by_setting(spark, sf):
    table = _runs(spark, sf)
    by = ["dataset_name", "model_name", "missingness_type", "method_key"]
    return runs.resume(runs.select_runs(table, None, by).where(
        F.col("model_name").isNotNull()).select(*by), table, by)


def i3_preview(spark, sf):
    return runs.preview(_runs(spark, sf).select("run_id", "dataset_key", "seed"))


def i4_run_matrix(spark, sf):
    """Two scenarios with all five methods, one unknown method, and a scenario that is not there.

    The table is written by a first call with half of the methods and resumed by a second one.
    """
    manifest = spark.createDataFrame(
        [(f"orders::{f}::{m}", "orders", "Orders", "o_totalprice", f, 10, 42, m)
         for f in ("MAR_TARGET", "MCAR_TARGET", "MNAR_TARGET") for m in ("meanmode", "medianmode", "mice", "missforest", "dae", "oracle")],
        "run_id string, dataset_key string, dataset_name string, target_column string, "
        "scenario_family string, rate_pct int, seed int, method_key string")
    full = orders(spark, sf).select("o_orderkey", "o_custkey", "o_totalprice")

    def load(dataset, family, rate):
        if family == "MAR_TARGET":
            return full, inject.mar(full, "o_custkey", "o_totalprice", rate / 100, ORDER_KEYS), \
                ORDER_KEYS
        if family == "MCAR_TARGET":
            return full, inject.mcar_column(full, rate / 100, "o_totalprice", ORDER_KEYS), \
                ORDER_KEYS
        return None

    path = scratch_path(spark, "runs")
    run_matrix(spark, manifest.where("method_key in ('meanmode', 'mice', 'oracle')"), load, path=path)
    found = run_matrix(spark, manifest, load, path=path)
    exact = F.col("method_key").isin("meanmode", "medianmode")
    return found.select(
        "run_id", "dataset_name", "scenario_family", "method_name", "status", "error_message",
        "n_masked_target", F.when(exact, F.round("mean_rmse", 3)).alias("mean_rmse"),
        F.when(exact, F.round("mean_nrmse", 7)).alias("mean_nrmse"),
        (F.col("mean_nrmse") < 2).alias("good"))


def i5_status_counts(spark, sf):
    return runs.status_counts(_runs(spark, sf))


def i6_aggregate_runs(spark, sf):
    out = runs.aggregate_runs(_runs(spark, sf))
    return out.withColumns({c: F.round(c, 5) for c in out.columns
                            if c.endswith("_mean") or c.endswith("_std")})


def _prompt_repeats(spark, sf):
    """Each prompt run three times; the third repeat has a broken timestamp."""
    times = ["2026-01-01T10:00:00+00:00", "2026-01-02T10:00:00+00:00", "not a time"]
    repeats = F.array(*[F.struct(F.lit(i).alias("repeat"), F.lit(t).alias("run_timestamp_utc"))
                        for i, t in enumerate(times)])
    table = _all_good(spark, sf).where(F.col("method_family") == "llm_prompt")
    return table.select("*", F.inline(repeats)).withColumns({
        "run_id": F.concat_ws("::", "run_id", F.col("repeat").cast("string")),
        "few_shot_k": F.lit(2),
        "status": F.when((F.col("repeat") == 1) & (F.col("model_key") == "qwen"), F.lit("error"))
        .otherwise(F.lit("success"))})


def i7_latest_prompt_runs(spark, sf):
    return runs.latest_prompt_runs(_prompt_repeats(spark, sf)).select(
        "run_id", "run_timestamp_utc", "dataset_name", "model_key")


def i8_unify_sources(spark, sf):
    table = _all_good(spark, sf).withColumn("run_timestamp_utc", F.lit("2026-01-01"))
    classical = table.where(F.col("method_family") == "classical")
    legacy = classical.where(F.col("seed") == 42).withColumns({
        "mean_rmse": F.lit(-1.0), "source_type": F.lit("classical_run_csv")})
    canonical = classical.where(F.col("method_key") != "dae").withColumn(
        "source_type", F.lit("classical_manifest_runner_csv"))
    out = runs.unify_sources(
        [(canonical, True), (legacy, False), (legacy.withColumn("mean_rmse", F.lit(-2.0)), False)],
        table.where(F.col("method_family") == "llm_finetuned"),
        _prompt_repeats(spark, sf))
    return out.select("run_id", "method_family", "source_type",
                      F.round("mean_rmse", 5).alias("mean_rmse"),
                      F.round("fallback_rate", 9).alias("fallback_rate"))


def _files(spark, sf):
    """Evaluation files of all models, data sets and scenarios, with two runs each."""
    def choice(values, salt):
        spot = F.floor(row_unit(6, ORDER_KEYS, salt) * len(values)) + 1
        return F.element_at(F.array(*[F.lit(v) for v in values]), spot.cast("int"))

    data = choice(["credit_billamt1", "statlog_x2", "telco_totalcharges"], "data")
    scenario = choice(["mar", "mcar", "mnar"], "scenario")
    model = choice(["qwen25", "llama31", "mistral"], "model")
    run = choice(["2026-06-01T08:00:00+00:00", "2026-06-02T08:00:00+00:00"], "run")
    answer = row_unit(6, ORDER_KEYS, "answer")
    return orders(spark, sf).select(
        "o_orderkey",
        F.concat(F.lit("/results/telco_Org_Model-7B_"), model, F.lit("_"), data, F.lit("_"),
                 scenario, F.lit("_lora_finetuned_eval.csv")).alias("file"),
        run.alias("run_timestamp_utc"),
        F.when(answer < 0.02, F.lit("n/a")).otherwise(
            (F.col("o_custkey") + 1).cast("string")).alias("prediction"),
        F.col("o_custkey").cast("double").alias("ground_truth"),
        F.when(answer < 0.9, F.lit("model_first_try")).otherwise(F.lit("fallback_median"))
        .alias("source"), F.concat(F.lit("Org/"), model).alias("model_name"))


def i9_parse_setting_name(spark, sf):
    return _files(spark, sf).select(
        "o_orderkey", runs.parse_setting_name(F.col("file")).alias("p")).select("o_orderkey", "p.*")


def i10_latest_eval(spark, sf):
    return runs.latest_eval(_files(spark, sf)).select(
        "o_orderkey", "file", "run_timestamp_utc", "prediction")


def i11_summary_from_detail(spark, sf):
    return runs.summary_from_detail(_files(spark, sf)).select(
        "run_id", "dataset_key", "dataset_name", "target_column", "scenario_family",
        "missingness_type", "model_key", "model_name", "n_masked_target",
        F.round("mean_rmse", 6).alias("mean_rmse"), F.round("mean_nrmse", 9).alias("mean_nrmse"),
        F.round("fallback_rate", 9).alias("fallback_rate"))


def _drivers(spark):
    return spark.createDataFrame(
        [(k, "o_custkey", "o_totalprice") for k, _ in _DATASETS.values()],
        "dataset_key string, mar_driver string, mnar_driver string")


def i12_derive_manifest(spark, sf):
    return runs.derive_manifest(_runs(spark, sf), _drivers(spark)).select(
        "run_id", "scenario_family", "mar_dependency_column", "mnar_driver_column",
        "mcar_global_excluded_columns", "include_in_primary_leaderboard")


def i13_check_primary_key(spark, sf):
    table = _runs(spark, sf)
    doubled = table.unionByName(table.where(F.col("model_key").eqNullSafe("qwen")
                                            | (F.col("method_key") == "dae")))
    return runs.check_primary_key(doubled)


def i14_check_completeness(spark, sf):
    grid = runs.scenario_grid(spark, [k for k, _ in _DATASETS.values()], _FAMILIES, [10, 15])
    done = _runs(spark, sf).where((F.col("status") == "success") & (F.col("method_key") == "mice"))
    return runs.check_completeness(
        grid, done, ["dataset_key", "scenario_family", "rate_pct"])


def i15_check_metrics(spark, sf):
    table = _runs(spark, sf).withColumns({
        "mean_nrmse": F.when(F.col("rate_pct") == 10, F.col("mean_nrmse")),
        "fallback_rate": F.when(F.col("model_key") != "qwen", F.col("fallback_rate"))})
    return runs.check_metrics(table)


def i16_check_mask_scope(spark, sf):
    full = orders(spark, sf)
    holed = inject.mcar(full, 0.1, ORDER_KEYS, 42, ["o_custkey", "o_totalprice"])
    columns = [c for c in full.columns if c not in ORDER_KEYS]
    pair = evaluate.side_by_side(full, holed, holed, ORDER_KEYS, columns)
    return runs.check_mask_scope(pair, columns, ["o_totalprice"])


def i17_scenario_location(spark, sf):
    keys = F.create_map(*[F.lit(x) for p in (
        ("F", "telco"), ("O", "statlog"), ("P", "creditcard")) for x in p])
    family = F.element_at(F.array(*[F.lit(f) for f in _FAMILIES]),
                          (F.col("o_custkey") % 4 + 1).cast("int"))
    rate = F.when(F.col("o_custkey") % 2 == 0, 10).otherwise(15)
    return orders(spark, sf).select("o_orderkey", runs.scenario_location(
        F.try_element_at(keys, F.col("o_orderstatus")), family, rate).alias("path"))


def i18_method_labels(spark, sf):
    k = (F.col("o_custkey") % 4).cast("int")
    return orders(spark, sf).select(
        "o_orderkey", runs.method_labels(k).alias("m"), runs.prompt_run_id(
            F.lower("o_orderstatus"), F.lit("qwen25"), F.lit("mar"), k,
            F.col("o_orderpriority")).alias("run_id")).select("o_orderkey", "m.*", "run_id")


def _report(df):
    return df.withColumns({
        c: F.round(f"`{c}`", 9) for c, t in df.dtypes if t == "double"})


def j1_comparison_rows(spark, sf):
    return reports.comparison_rows(_runs(spark, sf)).select("run_id", "row_key")


def j2_nrmse_matrix_all(spark, sf):
    return _report(reports.nrmse_matrix_all(_runs(spark, sf), _NAMES))


def j3_rank_matrix_all(spark, sf):
    return reports.rank_matrix_all(_runs(spark, sf), _NAMES)


def j4_leaderboard(spark, sf):
    return _report(reports.leaderboard(_runs(spark, sf)))


def j5_nrmse_matrix_classical(spark, sf):
    return _report(reports.nrmse_matrix_classical(_runs(spark, sf), _NAMES))


def j6_rank_matrix_classical(spark, sf):
    return reports.rank_matrix_classical(_runs(spark, sf), _NAMES)


def j7_rate_robustness(spark, sf):
    return _report(reports.rate_robustness(_runs(spark, sf)))


def j8_runtime_vs_error(spark, sf):
    return _report(reports.runtime_vs_error(_runs(spark, sf)))


def j9_scenario_robustness(spark, sf):
    return _report(reports.scenario_robustness(_runs(spark, sf), _NAMES))


def j10_nrmse_matrix_models(spark, sf):
    return _report(reports.nrmse_matrix_models(_runs(spark, sf), _NAMES))


def j11_rank_matrix_models(spark, sf):
    return reports.rank_matrix_models(_runs(spark, sf), _NAMES)


QUERIES = {f.__name__: f for f in (
    i1_select_runs, i1_prompt_settings, i2_resume, i2_resume_by_setting, i3_preview,
    i4_run_matrix, i5_status_counts, i6_aggregate_runs, i7_latest_prompt_runs, i8_unify_sources,
    i9_parse_setting_name, i10_latest_eval, i11_summary_from_detail, i12_derive_manifest,
    i13_check_primary_key, i14_check_completeness, i15_check_metrics, i16_check_mask_scope,
    i17_scenario_location, i18_method_labels, j1_comparison_rows, j2_nrmse_matrix_all,
    j3_rank_matrix_all, j4_leaderboard, j5_nrmse_matrix_classical, j6_rank_matrix_classical,
    j7_rate_robustness, j8_runtime_vs_error, j9_scenario_robustness, j10_nrmse_matrix_models,
    j11_rank_matrix_models)}


def _values(rows) -> str:
    def cell(v):
        if v is None:
            return "NULL::VARCHAR"
        return f"'{v}'" if isinstance(v, str) else (f"{v!r}::DOUBLE" if isinstance(v, float) else str(v))

    return "(VALUES " + ", ".join("(" + ", ".join(cell(v) for v in r) + ")" for r in rows) + ")"


_HOLE_DIGITS = sql_hex(42, ORDER_KEYS, "'o_totalprice'")
_RANKED_HOLES = f"""drawn AS (SELECT o_totalprice AS v, {_HOLE_DIGITS} AS digits, rank() OVER (ORDER BY o_custkey)
    + (count(*) OVER (PARTITION BY o_custkey) - 1) / 2.0::DOUBLE AS w FROM orders),
  holes AS (SELECT 'MCAR_TARGET' AS f, v, row_number() OVER (ORDER BY digits)
    <= floor(0.1::DOUBLE * count(*) OVER ()) AS hole FROM drawn
    UNION ALL SELECT 'MAR_TARGET', v, row_number() OVER (ORDER BY -ln({sql_slice("digits")}) / w, digits)
    <= round_even(0.1::DOUBLE * count(*) OVER (), 0) FROM drawn)"""
_DIGITS = ("md5(concat_ws(':', o_orderkey::VARCHAR, scenario_family, rate_pct::VARCHAR, "
           "method_family, method_key, model_key, seed::VARCHAR))")
_RUN_SQL = f"""scen AS (SELECT * FROM {_values(_SCENARIOS)} v(scenario_family, rate_pct)),
  meth AS (SELECT * FROM {_values(_METHODS)}
    v(method_family, method_key, method_name, model_key, seed, size)),
  data AS (SELECT * FROM {_values([(k, *v) for k, v in _DATASETS.items()])}
    v(o_orderstatus, dataset_key, dataset_name)),
  holes AS (SELECT o.o_orderkey, o.o_totalprice, dataset_key, dataset_name, scen.* FROM orders o
    JOIN data USING (o_orderstatus), scen WHERE {sql_slice(
      "md5(concat_ws(':', '42', o_orderkey::VARCHAR, scenario_family || ':' || rate_pct::VARCHAR))")}
      < rate_pct / 100::DOUBLE),
  detail AS (SELECT holes.*, meth.*, {_DIGITS} AS digits FROM holes, meth
    WHERE method_family = 'classical' OR (rate_pct = 10 AND scenario_family <> 'MCAR_GLOBAL')),
  answers AS (SELECT *, o_totalprice * (1 + size * ({sql_slice("digits")} - 0.5::DOUBLE)) AS p,
    {sql_slice("digits", 14)} < 0.9::DOUBLE AS first FROM detail),
  scored AS (SELECT dataset_key, dataset_name, scenario_family, rate_pct, seed, method_family,
    method_key, method_name, model_key, count(*) AS n_masked_target,
    sqrt(avg((o_totalprice - p) ** 2)) AS rmse, stddev_pop(o_totalprice) AS sd,
    avg(CASE WHEN first THEN 0.0::DOUBLE ELSE 1 END) AS fr FROM answers GROUP BY ALL),
  named AS (SELECT *, concat_ws('::', method_family, dataset_key, scenario_family,
    rate_pct::VARCHAR, seed::VARCHAR, method_key, model_key) AS run_id FROM scored),
  runs AS (SELECT run_id, dataset_key, dataset_name, scenario_family, rate_pct, seed,
    method_family, method_key, method_name, model_key, 'o_totalprice' AS target_column,
    split_part(scenario_family, '_', 1) AS missingness_type,
    lower(split_part(scenario_family, '_', 2)) AS mcar_scope,
    CASE WHEN method_family <> 'classical' THEN 'model/' || model_key END AS model_name,
    CASE WHEN substr(md5(run_id), 1, 1) = '0' THEN 'error' ELSE 'success' END AS status,
    n_masked_target, rmse AS mean_rmse, rmse / (sd + 1e-8::DOUBLE) AS mean_nrmse,
    n_masked_target / 1000::DOUBLE AS runtime_seconds,
    CASE WHEN method_family <> 'classical' THEN fr END AS fallback_rate FROM named)"""
_W = f"WITH {_RUN_SQL}"
_REPEATS = f"""{_RUN_SQL},
  repeats AS (SELECT run_id || '::' || i::VARCHAR AS run_id, t AS run_timestamp_utc, i,
    CASE WHEN i = 1 AND model_key = 'qwen' THEN 'error' ELSE 'success' END AS status,
    dataset_name, target_column, missingness_type, method_key, model_name, model_key, mean_rmse,
    fallback_rate FROM runs, (VALUES (0, '2026-01-01T10:00:00+00:00'),
    (1, '2026-01-02T10:00:00+00:00'), (2, 'not a time')) v(i, t)
    WHERE method_family = 'llm_prompt')"""


def _sql_choice(values, salt) -> str:
    listed = ", ".join(f"'{v}'" for v in values)
    return f"([{listed}])[floor({sql_unit(6, ORDER_KEYS, salt)} * {len(values)})::INTEGER + 1]"


_FILES = f"""picked AS (SELECT o_orderkey, o_custkey,
    {_sql_choice(["credit_billamt1", "statlog_x2", "telco_totalcharges"], "data")} AS d,
    {_sql_choice(["mar", "mcar", "mnar"], "scenario")} AS s,
    {_sql_choice(["qwen25", "llama31", "mistral"], "model")} AS m,
    {_sql_choice(["2026-06-01T08:00:00+00:00", "2026-06-02T08:00:00+00:00"], "run")}
      AS run_timestamp_utc, {sql_unit(6, ORDER_KEYS, "answer")} AS u FROM orders),
  files AS (SELECT *, 'telco_Org_Model-7B_' || m || '_' || d || '_' || s || '_lora_finetuned_eval'
      AS stem, CASE WHEN u >= 0.02 THEN (o_custkey + 1)::DOUBLE END AS prediction,
    o_custkey::DOUBLE AS ground_truth FROM picked),
  latest AS (SELECT * FROM files WHERE prediction IS NOT NULL
    QUALIFY run_timestamp_utc = max(run_timestamp_utc) OVER (PARTITION BY stem))"""


def _matrix(rows: dict, scope: str, value: str, tasks: list[tuple], rated: bool) -> str:
    """Report matrix: listed rows in order, one column per task."""
    task = "concat_ws('|', dataset_name, scenario_family" + (
        ", rate_pct::VARCHAR)" if rated else ")")
    cells = ", ".join(
        f"max({value}) FILTER (task = '{'|'.join(str(x) for x in t)}') AS "
        f"\"{'|'.join(str(x) for x in t)}\"" for t in tasks)
    listed = _values([(i, k, label) for i, (k, label) in enumerate(rows.items())])
    return f"""{_W}, keyed AS (SELECT *, CASE WHEN method_family = 'classical' THEN method_key
      ELSE method_family || '::' || model_key END AS row_key, {task} AS task FROM runs
      WHERE status = 'success' AND {scope}),
  cell AS (SELECT task, row_key, round(avg(mean_nrmse), 9) AS score,
    rank() OVER (PARTITION BY task ORDER BY avg(mean_nrmse))::INTEGER AS rank
    FROM keyed GROUP BY 1, 2)
  SELECT l.row_order, l.row_key, l.method_label, {cells}
  FROM (SELECT * FROM {listed} v(row_order, row_key, method_label)) l
  LEFT JOIN cell USING (row_key) GROUP BY 1, 2, 3"""


_TARGETS = "scenario_family <> 'MCAR_GLOBAL'"
_ALL = f"seed = 42 AND rate_pct = 10 AND {_TARGETS}"
_MODELS = f"rate_pct = 10 AND {_TARGETS} AND method_family <> 'classical'"
_CLASSICAL = "method_family = 'classical'"
_TASKS = [(d, s) for d in _NAMES for s in reports.TARGET_SCENARIOS]
_RATED = [(d, s, r) for d in _NAMES for s in reports.ALL_SCENARIOS for r in reports.RATES]


def _label(column: str, labels: dict) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in labels.items()) + " END"


_LOCATION = " ".join(
    f"WHEN o_orderstatus = '{status}' AND o_custkey % 4 = {i} THEN '"
    + runs.LOCATIONS[key][family].replace("{rate}", "' || rate || '") + "'"
    for status, key in (("F", "telco"), ("O", "statlog"), ("P", "creditcard"))
    for i, family in enumerate(_FAMILIES))
_AGGREGATES = ", ".join(
    f"round(avg({c}), 5) AS {c}_mean, round(coalesce(stddev_samp({c}), 0), 5) AS {c}_std"
    for c in runs.AGGREGATED)
_GROUP = ", ".join(runs.AGGREGATE_BY)

SQL = {
    "i1_select_runs": f"""{_W} SELECT run_id, dataset_key, method_key, rate_pct, seed FROM runs
  WHERE method_family = 'classical' AND dataset_key IN ('orders_f', 'orders_o')
    AND method_key IN ('mice', 'dae') AND rate_pct = 10 AND seed = 42""",
    "i1_prompt_settings": f"""{_W} SELECT DISTINCT dataset_name, target_column, missingness_type,
  model_key, model_name FROM runs
  WHERE method_family = 'llm_prompt' AND model_key IN ('qwen', 'llama')""",
    "i2_resume": f"{_W} SELECT run_id, method_key FROM runs WHERE status <> 'success'",
    "i2_resume_by_setting": f"""{_W} SELECT dataset_name, model_name, missingness_type, method_key
  FROM runs WHERE model_name IS NOT NULL GROUP BY ALL
  HAVING count(*) FILTER (status = 'success') = 0""",
    "i3_preview": f"{_W} SELECT run_id, dataset_key, seed FROM runs ORDER BY run_id LIMIT 30",
    "i4_run_matrix": f"""WITH {_RANKED_HOLES},
  scored AS (SELECT f, count(*) FILTER (hole) AS n, avg(v) FILTER (NOT hole) AS meanmode,
    quantile_cont(v, 0.5) FILTER (NOT hole) AS medianmode, stddev_pop(v) FILTER (hole) AS sd FROM holes GROUP BY f),
  errors AS (SELECT h.f, sqrt(avg((v - meanmode) ** 2)) AS meanmode, sqrt(avg((v - medianmode) ** 2)) AS medianmode
    FROM holes h JOIN scored USING (f) WHERE hole GROUP BY h.f),
  f AS (SELECT * FROM (VALUES ('MAR_TARGET'), ('MCAR_TARGET'), ('MNAR_TARGET')) v(f)),
  m AS (SELECT * FROM (VALUES ('meanmode', 'Mean/Mode'), ('medianmode', 'Median/Mode'),
    ('mice', 'MICE'), ('missforest', 'MissForest'), ('dae', 'DAE'), ('oracle', 'oracle')) v(m, name))
  SELECT 'orders::' || f.f || '::' || m AS run_id, 'Orders' AS dataset_name, f.f AS scenario_family,
    name AS method_name, CASE WHEN f.f = 'MNAR_TARGET' THEN 'missing_file' WHEN m = 'oracle'
      THEN 'error' ELSE 'success' END AS status,
    CASE WHEN f.f = 'MNAR_TARGET' THEN 'Missing scenario: orders/MNAR_TARGET/10'
      WHEN m = 'oracle' THEN 'Unknown imputer ''oracle''.' END AS error_message,
    CASE WHEN m <> 'oracle' THEN n END AS n_masked_target,
    round(CASE m WHEN 'meanmode' THEN errors.meanmode WHEN 'medianmode' THEN errors.medianmode END, 3) AS mean_rmse,
    round(CASE m WHEN 'meanmode' THEN errors.meanmode WHEN 'medianmode' THEN errors.medianmode END
      / (sd + 1e-8::DOUBLE), 7) AS mean_nrmse,
    CASE WHEN m <> 'oracle' AND n IS NOT NULL THEN TRUE END AS good
  FROM f CROSS JOIN m LEFT JOIN scored ON scored.f = f.f LEFT JOIN errors ON errors.f = f.f""",
    "i5_status_counts": f"{_W} SELECT status, count(*) AS n_runs FROM runs GROUP BY 1",
    "i6_aggregate_runs": f"""{_W} SELECT {_GROUP}, count(run_id) AS n_runs, {_AGGREGATES}
  FROM runs WHERE status = 'success' GROUP BY {_GROUP}""",
    "i7_latest_prompt_runs": f"""WITH {_REPEATS} SELECT run_id, run_timestamp_utc, dataset_name,
  model_key FROM repeats WHERE status = 'success' QUALIFY row_number() OVER (PARTITION BY
    dataset_name, target_column, missingness_type, method_key, model_name
    ORDER BY i <> 2 DESC, i DESC) = 1""",
    "i8_unify_sources": f"""WITH {_REPEATS}, united AS (
  SELECT run_id, method_family, CASE WHEN method_key <> 'dae' THEN 'classical_manifest_runner_csv'
      ELSE 'classical_run_csv' END AS source_type,
    CASE WHEN method_key <> 'dae' THEN mean_rmse ELSE -2.0::DOUBLE END AS mean_rmse, fallback_rate
  FROM runs WHERE method_family = 'classical' AND (method_key <> 'dae' OR seed = 42)
  UNION ALL SELECT run_id, method_family, NULL, mean_rmse, fallback_rate FROM runs
  WHERE method_family = 'llm_finetuned'
  UNION ALL SELECT run_id, 'llm_prompt', NULL, mean_rmse, fallback_rate FROM repeats)
  SELECT run_id, method_family, source_type, round(mean_rmse, 5) AS mean_rmse,
    round(fallback_rate, 9) AS fallback_rate FROM united""",
    "i9_parse_setting_name": f"""WITH {_FILES} SELECT o_orderkey, stem,
  split_part(d, '_', 1) AS dataset_token, m AS model_token, s AS scenario_token FROM files""",
    "i10_latest_eval": f"""WITH {_FILES} SELECT o_orderkey, '/results/' || stem || '.csv' AS file,
  run_timestamp_utc, prediction FROM latest""",
    "i11_summary_from_detail": f"""WITH {_FILES} SELECT
  concat_ws('::', 'inferred', stem, run_timestamp_utc) AS run_id,
  {_label("split_part(d, '_', 1)", {t[0]: t[2] for t in runs.DATASETS})} AS dataset_key,
  {_label("split_part(d, '_', 1)", {t[0]: t[3] for t in runs.DATASETS})} AS dataset_name,
  {_label("split_part(d, '_', 1)", {t[0]: t[4] for t in runs.DATASETS})} AS target_column,
  upper(s) || '_TARGET' AS scenario_family, upper(s) AS missingness_type,
  {_label("m", {t[0]: t[1] for t in runs.MODELS})} AS model_key, 'Org/' || m AS model_name,
  count(*) AS n_masked_target, round(sqrt(avg((ground_truth - prediction) ** 2)), 6) AS mean_rmse,
  round(sqrt(avg((ground_truth - prediction) ** 2)) / (stddev_pop(ground_truth) + 1e-8::DOUBLE), 9)
    AS mean_nrmse,
  round(avg(CASE WHEN u < 0.9 THEN 0.0::DOUBLE ELSE 1 END), 9) AS fallback_rate
  FROM latest GROUP BY stem, run_timestamp_utc, d, s, m""",
    "i12_derive_manifest": f"""{_W} SELECT run_id, scenario_family,
  CASE WHEN scenario_family = 'MAR_TARGET' THEN 'o_custkey' END AS mar_dependency_column,
  CASE WHEN scenario_family = 'MNAR_TARGET' THEN 'o_totalprice' END AS mnar_driver_column,
  NULL::VARCHAR AS mcar_global_excluded_columns, true AS include_in_primary_leaderboard
  FROM runs""",
    "i13_check_primary_key": f"""{_W} SELECT dataset_key, scenario_family, rate_pct, seed,
  method_key, model_key, 2::BIGINT AS n_rows FROM runs
  WHERE model_key = 'qwen' OR method_key = 'dae'""",
    "i14_check_completeness": f"""{_W} SELECT d AS dataset_key, scenario_family, rate_pct
  FROM scen, (VALUES ('orders_f'), ('orders_o'), ('orders_p')) v(d)
  WHERE NOT EXISTS (SELECT 1 FROM runs r WHERE r.dataset_key = d AND status = 'success'
    AND method_key = 'mice' AND r.scenario_family = scen.scenario_family
    AND r.rate_pct = scen.rate_pct)""",
    "i15_check_metrics": f"""{_W} SELECT count(*) AS n_success,
  count(*) FILTER (mean_rmse IS NULL) AS no_rmse, count(*) FILTER (rate_pct <> 10) AS no_nrmse,
  count(*) FILTER (model_key = 'qwen') AS no_fallback_rate FROM runs WHERE status = 'success'""",
    "i16_check_mask_scope": f"""SELECT 'o_custkey' AS column_name, count(*) AS n_new_holes
  FROM orders WHERE {sql_unit(42, ORDER_KEYS, "o_custkey")} < 0.1::DOUBLE""",
    "i17_scenario_location": f"""SELECT o_orderkey, CASE {_LOCATION} END AS path FROM (
  SELECT *, CASE WHEN o_custkey % 2 = 0 THEN '10' ELSE '15' END AS rate FROM orders)""",
    "i18_method_labels": """WITH o AS (SELECT *, (o_custkey % 4)::VARCHAR AS k FROM orders)
  SELECT o_orderkey, CASE WHEN k = '0' THEN 'llm_prompt_zero' ELSE 'llm_prompt_fewshot_k' || k END
    AS method_key, CASE WHEN k = '0' THEN 'LLM Prompt Zero-shot'
      ELSE 'LLM Prompt Few-shot k=' || k END AS method_name,
    CASE WHEN k = '0' THEN 'zero' ELSE 'few' || k END AS prompt_token,
    concat_ws('::', 'prompt', lower(o_orderstatus), 'qwen25', 'mar', 'k' || k, o_orderpriority)
      AS run_id FROM o""",
    "j1_comparison_rows": f"""{_W} SELECT run_id, CASE WHEN method_family = 'classical'
  THEN method_key ELSE method_family || '::' || model_key END AS row_key
  FROM runs WHERE status = 'success' AND {_ALL}""",
    "j2_nrmse_matrix_all": _matrix(reports.ALL_ROWS, _ALL, "score", _TASKS, False),
    "j3_rank_matrix_all": _matrix(reports.ALL_ROWS, _ALL, "rank", _TASKS, False),
    "j4_leaderboard": f"""{_W}, keyed AS (SELECT *, CASE WHEN method_family = 'classical'
    THEN method_key ELSE method_family || '::' || model_key END AS row_key
    FROM runs WHERE status = 'success' AND {_ALL})
  SELECT row_key, round(avg(mean_nrmse), 9) AS mean_nrmse,
    round(stddev_samp(mean_nrmse), 9) AS nrmse_std, count(*) AS n_tasks,
    {_label("row_key", reports.ALL_ROWS)} AS method_label,
    {_label("row_key", {k: i for i, k in enumerate(reports.ALL_ROWS)})}::INTEGER AS plot_order
  FROM keyed GROUP BY 1""",
    "j5_nrmse_matrix_classical": _matrix(reports.METHODS, _CLASSICAL, "score", _RATED, True),
    "j6_rank_matrix_classical": _matrix(reports.METHODS, _CLASSICAL, "rank", _RATED, True),
    "j7_rate_robustness": f"""{_W} SELECT scenario_family, rate_pct, method_key,
  round(avg(mean_nrmse), 9) AS mean_nrmse_avg,
  {_label("scenario_family", reports.ROBUSTNESS_LABELS)} AS scenario_label,
  {_label("method_key", reports.METHODS)} AS method_label FROM runs
  WHERE status = 'success' AND {_CLASSICAL} GROUP BY 1, 2, 3""",
    "j8_runtime_vs_error": f"""{_W} SELECT method_key,
  round(avg(runtime_seconds), 9) AS mean_runtime_seconds, round(avg(mean_nrmse), 9) AS mean_nrmse,
  round(stddev_samp(runtime_seconds), 9) AS runtime_std_seconds,
  round(stddev_samp(mean_nrmse), 9) AS nrmse_std, count(*) AS n_runs,
  {_label("method_key", reports.METHODS)} AS method_label FROM runs
  WHERE status = 'success' AND {_CLASSICAL} GROUP BY 1""",
    "j9_scenario_robustness": f"""{_W} SELECT dataset_name, scenario_family, model_key,
  round(avg(mean_nrmse), 9) AS mean_nrmse_avg,
  {_label("scenario_family", reports.SCENARIO_LABELS)} AS scenario_label,
  {_label("model_key", reports.MODELS)} AS model_label FROM runs
  WHERE status = 'success' AND {_MODELS} AND method_family = 'llm_finetuned' GROUP BY 1, 2, 3""",
    "j10_nrmse_matrix_models": _matrix(reports.MODEL_ROWS, _MODELS, "score", _TASKS, False),
    "j11_rank_matrix_models": _matrix(reports.MODEL_ROWS, _MODELS, "rank", _TASKS, False),
}
