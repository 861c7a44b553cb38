import pytest
from pyspark.sql import functions as F

from lacunae import schemas
from lacunae.operators import inject, reports, runs
from lacunae.plans.benchmark import run_matrix
from lacunae.sources import results


def _run(i, **over):
    row = {"run_id": f"r{i}", "dataset_key": "d", "dataset_name": "D", "target_column": "t",
           "scenario_family": "MAR_TARGET", "missingness_type": "MAR", "rate_pct": 10, "seed": 42,
           "method_family": "classical", "method_key": "mice", "method_name": "MICE",
           "status": "success", "n_masked_target": 10, "mean_rmse": 1.0, "mean_nrmse": 0.5,
           "runtime_seconds": 1.0}
    return {**row, **over}


def _table(spark, rows, schema=schemas.PROMPT_RUN):
    return spark.createDataFrame([tuple(r.get(n) for n in schema.fieldNames()) for r in rows], schema)


def test_selection(spark):
    table = _table(spark, [_run(1), _run(2, seed=202), _run(3, method_family="llm_prompt"),
                           _run(4, rate_pct=15)])
    ids = lambda df: sorted(r["run_id"] for r in df.collect())
    assert ids(runs.select_runs(table)) == ["r1", "r2", "r4"]
    assert ids(runs.select_runs(table, rate_pct=["10"], seed=[42, "303"])) == ["r1"]
    assert ids(runs.select_runs(table, None, ["dataset_key"])) != []
    done = _table(spark, [_run(1), _run(2, status="error")])
    assert ids(runs.resume(runs.select_runs(table), done)) == ["r2", "r4"]
    assert ids(runs.resume(table, table.limit(0))) == ["r1", "r2", "r3", "r4"]
    assert ids(runs.preview(table, 2)) == ["r1", "r2"]
    with pytest.raises(ValueError):
        runs.preview(table, 0)
    counts = {r["status"]: r["n_runs"] for r in runs.status_counts(done).collect()}
    assert counts == {"success": 1, "error": 1}


def test_aggregation_keeps_null_keys_and_single_runs(spark):
    table = _table(spark, [_run(1, mean_rmse=1.0), _run(2, mean_rmse=3.0), _run(3, status="error"),
                           _run(4, model_key="m")])
    got = {r["model_key"]: r for r in runs.aggregate_runs(table).collect()}
    assert got[None]["n_runs"] == 2 and got[None]["mean_rmse_mean"] == 2.0
    assert got[None]["mean_rmse_std"] == pytest.approx(2 ** 0.5)
    assert got["m"]["mean_rmse_std"] == 0.0
    with pytest.raises(ValueError):
        runs.aggregate_runs(table.select("status", "run_id"))


def test_latest_prompt_run_ignores_broken_times(spark):
    base = dict(method_family="llm_prompt", model_name="m", few_shot_k=2)
    table = _table(spark, [
        _run(1, run_timestamp_utc="2026-01-01T00:00:00Z", **base),
        _run(2, run_timestamp_utc="2026-01-02T00:00:00Z", **base),
        _run(3, run_timestamp_utc="soon", **base),
        _run(4, run_timestamp_utc="2026-01-03T00:00:00Z", **{**base, "status": "error"}),
        _run(5, run_timestamp_utc="bad", **{**base, "few_shot_k": 0})])
    assert sorted(r["run_id"] for r in runs.latest_prompt_runs(table).collect()) == ["r2", "r5"]


def test_unify_prefers_the_canonical_source(spark):
    a = _table(spark, [_run(1, mean_rmse=1.0), _run(2, mean_rmse=1.0)])
    b = _table(spark, [_run(1, mean_rmse=2.0), _run(3, mean_rmse=2.0)])
    c = _table(spark, [_run(3, mean_rmse=3.0)])
    got = {r["run_id"]: r["mean_rmse"] for r in runs.unify_sources(
        [(a, True), (b, False), (c, False)]).collect()}
    assert got == {"r1": 1.0, "r2": 1.0, "r3": 3.0}
    assert runs.unify_sources([(a, False)], b.drop("mean_nrmse"), c).columns == \
        schemas.RUN.fieldNames()


def test_file_names(spark):
    names = {
        "/x/telco_O_q_qwen25_statlog_x2_mnar_lora_finetuned_eval.csv": ("statlog", "qwen25", "mnar"),
        "telco_O_l_llama31_credit_billamt1_mcar_lora_finetuned_eval.csv": ("credit", "llama31", "mcar"),
        "t_mistral_telco_totalcharges_lora_finetuned_eval.csv": ("telco", "mistral", "mar")}
    df = spark.createDataFrame([(n,) for n in names], "p string")
    for r in df.select("p", runs.parse_setting_name(F.col("p")).alias("n")).collect():
        assert tuple(r["n"])[1:] == names[r["p"]]
    for bad in ("a_qwen25_statlog_x2_mar.csv", "a_gpt_statlog_x2_mar_lora_finetuned_eval.csv"):
        wrong = spark.createDataFrame([(bad,)], "p string")
        with pytest.raises(Exception):
            wrong.select(runs.parse_setting_name(F.col("p"))).collect()


def test_summary_uses_the_latest_run(spark):
    name = "t_qwen25_statlog_x2_mar_lora_finetuned_eval.csv"
    detail = spark.createDataFrame(
        [(name, "2026-01-01", 9.0, 1.0, "model_first_try", "m"),
         (name, "2026-01-02", 1.0, 1.0, "model_first_try", "m"),
         (name, "2026-01-02", 3.0, 5.0, "model_retry", "m"),
         (name, "2026-01-02", None, 5.0, "model_retry", "m")],
        "file string, run_timestamp_utc string, prediction double, ground_truth double, "
        "source string, model_name string")
    row = runs.summary_from_detail(detail).first()
    assert row["run_id"] == f"inferred::{name[:-4]}::2026-01-02"
    assert (row["n_masked_target"], row["fallback_rate"]) == (2, 0.5)
    assert row["mean_rmse"] == pytest.approx(2 ** 0.5)
    manifest = runs.derive_manifest(runs.summary_from_detail(detail)).first()
    assert (manifest["mar_dependency_column"], manifest["mnar_driver_column"]) == ("X5", None)


def test_checks(spark):
    table = _table(spark, [_run(1), _run(2), _run(3, model_key="m", method_family="llm_prompt"),
                           _run(4, seed=7, mean_rmse=None)])
    assert [r["n_rows"] for r in runs.check_primary_key(table).collect()] == [2]
    grid = runs.scenario_grid(spark, ["d", "e"], ["MAR_TARGET"], [10, 15])
    keys = ["dataset_key", "scenario_family", "rate_pct"]
    missing = {tuple(r) for r in runs.check_completeness(grid, table, keys).collect()}
    assert missing == {("d", "MAR_TARGET", 15), ("e", "MAR_TARGET", 10), ("e", "MAR_TARGET", 15)}
    assert tuple(runs.check_metrics(table).first()) == (4, 1, 0, 1)
    pair = spark.createDataFrame(
        [(1.0, None, 1.0, None), (1.0, 1.0, None, None)],
        "truth__a double, holed__a double, truth__b double, holed__b double")
    bad = runs.check_mask_scope(pair, ["a", "b"], ["b"]).collect()
    assert [(r["column_name"], r["n_new_holes"]) for r in bad] == [("a", 1)]


def test_locations_and_labels(spark):
    df = spark.createDataFrame([("telco", "MCAR_GLOBAL", 15, 0)], "d string, f string, r int, k int")
    place = runs.scenario_location(F.col("d"), F.col("f"), F.col("r"))
    assert df.select(place).first()[0] == "MCAR/telco_customer_churn_mcar_15pct.csv"
    with pytest.raises(Exception, match="No scenario location"):
        df.select(runs.scenario_location(F.col("d"), F.lit("X"), F.col("r"))).collect()
    got = df.select(runs.method_labels(F.col("k")).alias("a"),
                    runs.method_labels(F.col("k") + 2).alias("b")).first()
    assert tuple(got["a"]) == ("llm_prompt_zero", "LLM Prompt Zero-shot", "zero")
    assert tuple(got["b"]) == ("llm_prompt_fewshot_k2", "LLM Prompt Few-shot k=2", "few2")


def test_matrix_runner(spark, numbers):
    manifest = _table(spark, [
        _run(1, dataset_key="n", target_column="y", method_key="meanmode", method_name=None),
        _run(2, dataset_key="n", target_column="y", method_key="nothing"),
        _run(3, dataset_key="lost", target_column="y")], schemas.MANIFEST)
    from lacunae.operators import inject
    holed = inject.mcar_column(numbers, 0.1, "y", ["k"])

    def load(dataset, family, rate):
        return (numbers, holed, ["k"]) if dataset == "n" else None

    got = {r["run_id"]: r for r in run_matrix(spark, manifest, load).collect()}
    assert [got[r]["status"] for r in ("r1", "r2", "r3")] == ["success", "error", "missing_file"]
    assert got["r1"]["n_masked_target"] == 200 and got["r1"]["method_name"] == "Mean/Mode"
    assert "Unknown imputer" in got["r2"]["error_message"]
    with pytest.raises(FileNotFoundError):
        run_matrix(spark, manifest, load, skip_missing=False)
    with pytest.raises(ValueError):
        run_matrix(spark, manifest.where("run_id = 'r2'"), load, fail_fast=True)


def test_a_stopped_matrix_is_resumed(spark, numbers, tmp_path):
    """Rows are on disk as experiments end: after a loss only what is missing runs again."""
    path = str(tmp_path / "runs")
    manifest = _table(spark, [_run(i, target_column="y", method_key=m, status=None, method_name=None)
                              for i, m in enumerate(["meanmode", "medianmode", "oracle", "mice"])])
    loaded, lives = [], [2]

    def load(*place):
        if not lives[0]:
            raise KeyboardInterrupt  # the driver goes
        lives[0] -= 1
        loaded.append(place)
        return numbers, inject.mcar_column(numbers, 0.1, "y", ["k"]), ["k"]

    with pytest.raises(KeyboardInterrupt):
        run_matrix(spark, manifest, load, path=path, side_by_side=1)
    assert {r.run_id: r.status for r in results.read_runs(spark, path).collect()} == {"r0": "success", "r1": "success"}
    lives[0] = 99
    out = {r.run_id: r for r in run_matrix(spark, manifest, load, path=path).collect()}
    assert [out[f"r{i}"].status for i in range(4)] == ["success", "success", "error", "success"]
    assert len(loaded) == 4 and out["r3"].mean_rmse < out["r0"].mean_rmse
    # The failed one is tried again and replaces its row; the others are left alone.
    with pytest.raises(ValueError):
        run_matrix(spark, manifest, load, path=path, fail_fast=True)
    assert len(loaded) == 5 and results.read_runs(spark, path).count() == 4
    board = reports.leaderboard(results.read_runs(spark, path).where("status = 'success'")).collect()
    assert {r["row_key"] for r in board} >= {"mice", "meanmode", "medianmode"}


def test_reports(spark):
    table = _table(spark, [
        _run(1, dataset_name="Telco", mean_nrmse=0.4),
        _run(2, dataset_name="Telco", method_key="dae", mean_nrmse=0.4),
        _run(3, dataset_name="Telco", method_key="meanmode", mean_nrmse=1.0),
        _run(4, dataset_name="Telco", method_family="llm_prompt", model_key="qwen", mean_nrmse=0.6),
        _run(5, dataset_name="Telco", scenario_family="MCAR_GLOBAL", mean_nrmse=9.0),
        _run(6, dataset_name="Telco", method_family="llm_finetuned", model_key="qwen",
             mean_nrmse=0.2)])
    ranks = {r["method_label"]: r["Telco|MAR_TARGET"] for r in reports.rank_matrix_all(table).collect()}
    assert len(ranks) == 11
    assert ranks["Qwen 2.5 Finetuned"] == 1 and ranks["MICE"] == ranks["DAE"] == 2
    assert ranks["Qwen 2.5 Prompt"] == 4 and ranks["Mean/Mode"] == 5 and ranks["MissForest"] is None
    board = reports.leaderboard(table).collect()
    assert [r["row_key"] for r in board] == [
        "llm_finetuned::qwen", "dae", "mice", "llm_prompt::qwen", "meanmode"]
    assert board[0]["nrmse_std"] is None and board[0]["plot_order"] == 10
    classical = reports.nrmse_matrix_classical(table).where("row_key = 'mice'").first()
    assert classical["Telco|MCAR_GLOBAL|10"] == 9.0 and classical["Telco|MAR_TARGET|15"] is None
    models = reports.nrmse_matrix_models(table).collect()
    assert [r["row_key"] for r in models][-1] == "llm_finetuned::qwen" and len(models) == 6
    assert reports.rate_robustness(table).first()["scenario_label"] == "MAR target-only"
    assert reports.scenario_robustness(table).first()["model_label"] == "Qwen 2.5"
    assert {r["method_key"]: r["n_runs"] for r in reports.runtime_vs_error(table).collect()} == {
        "meanmode": 1, "mice": 2, "dae": 1}
    with pytest.raises(Exception, match="no runtime"):
        reports.runtime_vs_error(_table(spark, [_run(1, runtime_seconds=None)])).collect()
