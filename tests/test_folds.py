import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lacunae.operators import evaluate, folds, order
from lacunae.plans.benchmark import cross_validate


def test_contiguous(spark):
    df = spark.range(11).withColumnRenamed("id", "k")
    got = folds.contiguous_folds(df, ["k"], 4).groupBy("fold_id").count().orderBy("fold_id").collect()
    assert [r["count"] for r in got] == [3, 3, 3, 2]
    assert folds.contiguous_folds(df.limit(2), ["k"], 5).agg(F.max("fold_id")).first()[0] == 2
    with pytest.raises(ValueError):
        folds.contiguous_folds(df, ["k"], 0)


# Bin edges that fall exactly on a rank belong to the lower bin here; pandas rounds them either
# way, so the sizes below have no such edge or a whole-number one that pandas keeps.
@pytest.mark.parametrize("n,q", [(11, 3), (101, 10), (18, 5), (40, 8)])
def test_bins_match_quantile_cut(spark, n, q):
    df = spark.range(n).select(F.col("id").alias("k"), (F.col("id") * 7 % n).alias("v"))
    got, used = folds.stratify_bins(df, "v", ["k"], 2, q)
    used_by_pandas = pd.qcut(pd.Series(range(1, n + 1)).astype(float), used, labels=False)
    pdf = got.toPandas().sort_values(["v", "k"])
    assert pdf["bin"].tolist() == used_by_pandas.tolist()
    assert folds._bin_sizes(n, used) == used_by_pandas.value_counts().sort_index().tolist()


def test_bin_choice():
    assert folds.choose_bins(100, 50, 5, 10) == 10
    assert folds.choose_bins(100, 3, 5, 10) == 3
    assert folds.choose_bins(9, 9, 5, 10) == 0
    assert folds.choose_bins(100, 1, 5, 10) == 0


def test_kfold_is_balanced_in_every_bin(numbers):
    got = folds.stratified_kfold(numbers.select("k", "y"), "y", ["k"], 4).toPandas()
    sizes = got.groupby(["bin", "fold_id"]).size().unstack()
    assert (sizes.max(axis=1) - sizes.min(axis=1)).max() <= 1
    with pytest.raises(ValueError):
        folds.stratified_kfold(numbers, "y", ["k"], 1)


def test_reveal(spark):
    df = spark.createDataFrame(
        [(1.0, 1.0, None), (None, 2.0, 1), (None, 3.0, 2), (None, None, 2)],
        "v double, t double, f int")
    got = [r[0] for r in df.select(folds.fold_reveal("v", "t", "f", 1)).collect()]
    assert got == [1.0, None, 3.0, None]


@pytest.mark.parametrize("bucket_rows", [16, 10**6])
def test_nearest_required(numbers, bucket_rows):
    rows = order.with_position(numbers.select("k"), ["k"]).withColumn(
        "need", F.col("k").isin(3, 50, 51, 1990))
    got = folds.nearest_required(
        rows, "position", F.col("need"), bucket_rows=bucket_rows).orderBy("k").toPandas()
    marks = np.array([3, 50, 51, 1990])
    want = np.abs(got["position"].to_numpy()[:, None] - marks[None, :]).min(axis=1)
    assert (got["distance"] == want).all()


def test_context_keeps_required_rows_and_the_nearest(spark):
    df = spark.createDataFrame(
        [(i, None if i in (2, 7, 8) else float(i), i in (2, 8)) for i in range(10)],
        "position long, v double, need boolean")
    got = folds.compact_context(df, "v", "need", 6).orderBy("context_position").collect()
    assert [r["position"] for r in got] == [2, 8, 1, 3, 9, 0]
    every = folds.compact_context(df, "v", "need", None).orderBy("context_position").collect()
    assert [r["position"] for r in every] == [2, 8, 0, 1, 3, 4, 5, 6, 7, 9]
    tight = folds.compact_context(df, "v", "need", 1).collect()
    assert sorted(r["position"] for r in tight) == [2, 8]


def test_train_median(spark):
    df = spark.createDataFrame([(1, 1.0), (1, 9.0), (2, 4.0), (2, None), (3, 6.0)], "f int, v double")
    got = {r["f"]: r["train_median"] for r in folds.fold_train_median(df, "v", "f", 3).collect()}
    assert got == {1: 5.0, 2: 6.0, 3: 4.0}


def test_samples(numbers):
    rows = numbers.select("k")
    got = folds.sample_records(rows, 30, ["k"]).orderBy("sample_position").collect()
    assert [r["sample_position"] for r in got] == list(range(30))
    again = folds.sample_records(rows.repartition(6), 30, ["k"]).orderBy("sample_position").collect()
    assert [r["k"] for r in got] == [r["k"] for r in again] != sorted(r["k"] for r in got)
    with pytest.raises(ValueError):
        folds.sample_records(rows, 2001, ["k"])


def test_cross_validation(numbers):
    answers, split = cross_validate(numbers.drop("label"), "y", ["k"], "mice", 3)
    assert answers.count() == 2000 and answers.select("k").distinct().count() == 2000
    score = evaluate.answer_metrics(answers).first()
    assert score["mean_nrmse"] < 0.05 and score["fallback_rate"] == 0.0
    sizes = {r["fold_id"]: (r["cv_test_size"], r["cv_train_size"]) for r in split.collect()}
    assert sum(t for t, _ in sizes.values()) == 2000 and all(a + b == 2000 for a, b in sizes.values())


def test_cross_validation_orders_the_rows_once(numbers):
    """Folds are read from a kept table: no plan of the answers or the manifest sorts the rows into bins again."""
    answers, manifest = cross_validate(numbers.select("k", "y"), "y", ["k"], "meanmode", 3)
    assert answers.count() == 2000 and manifest.agg({"cv_test_size": "sum"}).first()[0] == 2000
    for found in (answers, manifest):
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert "Window" not in plan and "parquet" in plan
