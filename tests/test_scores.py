import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lacunae.operators import evaluate
from lacunae.operators.fallback import domain_fallback
from lacunae.plans.benchmark import log_result
from lacunae.sources import results


@pytest.fixture
def pair(spark):
    """Column a: two scored holes, one unknown truth, one unfilled; column b: no hole."""
    full = spark.createDataFrame(
        [(1, 1.0, 5.0), (2, 2.0, 5.0), (3, None, 5.0), (4, 8.0, 5.0), (5, 4.0, 5.0)],
        "k int, a double, b double")
    holed = spark.createDataFrame(
        [(1, None, 5.0), (2, 2.0, 5.0), (3, None, 5.0), (4, None, 5.0), (5, None, 5.0)],
        "k int, a double, b double")
    filled = spark.createDataFrame(
        [(1, 2.0, 5.0), (2, 2.0, 5.0), (3, 9.0, 5.0), (4, 6.0, 5.0), (5, None, 5.0)],
        "k int, a double, b double")
    return evaluate.side_by_side(full, holed, filled, ["k"], ["a", "b"])


def test_column_scores(pair):
    a, b = sorted(evaluate.column_scores(pair, ["a", "b"]).collect())
    assert (a["n_masked"], a["n_unfilled"]) == (3, 1)
    assert a["rmse"] == pytest.approx(math.sqrt((1 + 4) / 2))
    # The spread is that of all true values in the holes, filled or not.
    assert a["nrmse"] == pytest.approx(a["rmse"] / (np.std([1, 8, 4]) + 1e-8))
    assert (b["n_masked"], b["rmse"], b["nrmse"]) == (0, None, None)
    ranged = evaluate.nrmse(pair, ["a"], "range").first()["nrmse"]
    assert ranged == pytest.approx(a["rmse"] / (7 + 1e-8))
    with pytest.raises(ValueError):
        evaluate.nrmse(pair, ["a"], "iqr")
    mean = evaluate.mean_over_columns(evaluate.column_scores(pair, ["a", "b"])).first()
    assert mean["mean_rmse"] == a["rmse"]
    assert evaluate.checked_target_score(pair, "a")["n_masked_target"] == 3
    with pytest.raises(ValueError):
        evaluate.checked_target_score(pair, "b")


def test_detail_and_log(pair):
    run = {"dataset": "D", "missingness_type": "MAR", "missing_rate": "10%",
           "imputation_method": "Mean/Mode"}
    rows = evaluate.detail_rows(pair, ["k"], ["a", "b"], run).orderBy("k").collect()
    assert [(r["k"], r["prediction"], r["ground_truth"], r["abs_error"]) for r in rows] == [
        (1, 2.0, 1.0, 1.0), (4, 6.0, 8.0, 2.0), (5, None, 4.0, None)]
    detail, rmse, nrmse = log_result(pair, ["k"], ["a", "b"], run)
    assert detail.count() == 3 and rmse.first()["mean_rmse"] == pytest.approx(math.sqrt(2.5))
    assert "mean_nrmse" in nrmse.columns
    with pytest.raises(ValueError):
        log_result(pair, ["k"], ["b"], run)


def test_logged_results_are_read_back(spark, pair, tmp_path):
    root = str(tmp_path)
    run = {"dataset": "d", "missingness_type": "MAR", "missing_rate": "10", "imputation_method": "mean"}
    for _ in range(2):  # the second call replaces the first
        detail, rmse, nrmse = log_result(pair, ["k"], ["a", "b"], run, root)
    assert detail.count() == 3 and rmse.count() == nrmse.count() == 1
    log_result(pair, ["k"], ["a", "b"], {**run, "imputation_method": "median"}, root)
    assert results.read_results(spark, root, "detail").count() == 6
    assert {r.run_id for r in results.read_results(spark, root, "rmse").collect()} == {"d|MAR|10|mean", "d|MAR|10|median"}
    # A call that is cut off before the end leaves nothing that readers see.
    broken = {"detail": rmse, "rmse": rmse.select(F.raise_error(F.lit("lost")).alias("mean_rmse"))}
    with pytest.raises(Exception, match="lost"):
        results.commit_results(broken, root, "half")
    assert results.read_results(spark, root, "detail").where("run_id = 'half'").count() == 0


@pytest.fixture
def detail(spark):
    return spark.createDataFrame(
        [("m", 1, 1.0, 2.0, "model_first_try", 1.0), ("m", 2, 5.0, 4.0, "model_retry", 1.0),
         ("m", 3, None, 4.0, "model_first_try", None), ("m", 4, 4.0, 4.0, None, 0.0),
         ("n", 1, float("nan"), 1.0, "fallback_median", None)],
        "model string, k int, prediction double, ground_truth double, source string, abs_error double")


def test_answer_metrics(detail, spark):
    rows = {r["model"]: r for r in evaluate.answer_metrics(detail, ["model"]).collect()}
    assert set(rows) == {"m"} and rows["m"]["n_valid"] == 3
    assert rows["m"]["mean_rmse"] == pytest.approx(math.sqrt(2 / 3))
    assert rows["m"]["mean_nrmse"] == pytest.approx(math.sqrt(2 / 3) / (np.std([2, 4, 4]) + 1e-8))
    assert rows["m"]["fallback_rate"] == pytest.approx(2 / 3)
    full = spark.createDataFrame([(0.0,), (10.0,), (None,)], "v double")
    whole = evaluate.nrmse_full_population(detail, full, "v").first()
    assert whole["mean_nrmse"] == pytest.approx(math.sqrt(2 / 3) / 5)
    counts = {r["source"]: r["n_rows"] for r in evaluate.source_counts(detail).collect()}
    assert counts == {"model_first_try": 2, "model_retry": 1, None: 1, "fallback_median": 1}


def test_running_mae(detail):
    got = evaluate.running_mae(detail, ["model"], ["k"]).orderBy("model", "k").collect()
    assert [r["running_mae"] for r in got] == [1.0, 1.0, 1.0, pytest.approx(2 / 3), None]


def test_carried_values_equal_the_joined_form(numbers):
    from lacunae.operators import inject
    from lacunae.operators.mice import Mice

    cols = ["y"]
    full = evaluate.with_truth(numbers, cols)
    holed = evaluate.with_holes(inject.mcar_column(full, 0.1, "y", ["k"]), cols)
    filled = Mice(["k", *evaluate.carried(cols)]).fit_transform(holed)
    one = evaluate.evaluate_target(evaluate.as_filled(filled, cols), "y").first()
    plain = inject.mcar_column(numbers, 0.1, "y", ["k"])
    two = evaluate.evaluate_target(evaluate.side_by_side(
        numbers, plain, Mice(["k"]).fit_transform(plain), ["k"], cols), "y").first()
    assert one["n_masked_target"] == two["n_masked_target"] == 200
    assert one["mean_rmse"] == pytest.approx(two["mean_rmse"])


def test_fallback(spark):
    df = spark.createDataFrame(
        [(1.0, 2.0, 3.0), (None, 2.0, 3.0), (None, None, 3.0)], "t double, Tenure double, fee double")
    got = [(r["fallback_value"], r["fallback_source"])
           for r in domain_fallback(df, "t", ["Tenure", "fee"], 7.0).collect()]
    assert got == [(None, None), (6.0, "fallback_tenure_x_fee"), (7.0, "fallback_median")]
    plain = domain_fallback(df, "t", None, 7.0).where("t is null").collect()
    assert {r["fallback_value"] for r in plain} == {7.0}
