import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lacunae.operators import evaluate, inject
from lacunae.operators.forest import MissForest
from lacunae.operators.trees import Growth, _deals, _tops, draws, grow, n_picked, predicted, quantile_cuts


def naive(codes, w, y, n_classes, max_depth, min_leaf, depth=0):
    """Predictions for the rows themselves, cut by cut; all features at every node."""
    def squares(rows):
        if not n_classes:
            return (w[rows] * y[rows]).sum() ** 2
        return sum(w[rows][y[rows] == c].sum() ** 2 for c in range(n_classes))

    if n_classes:
        votes = [w[y == c].sum() for c in range(n_classes)]
        value = float(np.argmax(votes))
    else:
        value = (w * y).sum() / w.sum()
    out = np.full(len(y), value)
    best = (-np.inf, None)
    if depth < max_depth and len(set(y.tolist())) > 1 and len(y) >= 2 * min_leaf:
        for f in range(codes.shape[1]):
            for c in np.unique(codes[:, f])[:-1]:
                left = codes[:, f] <= c
                if min(left.sum(), (~left).sum()) >= min_leaf:
                    gain = squares(left) / w[left].sum() + squares(~left) / w[~left].sum()
                    if gain > best[0]:
                        best = gain, left
    if best[1] is not None:
        for side in (best[1], ~best[1]):
            out[side] = naive(codes[side], w[side], y[side], n_classes, max_depth, min_leaf, depth + 1)
    return out


@settings(max_examples=120, deadline=None)
@given(st.integers(1, 40), st.integers(1, 4), st.sampled_from([0, 0, 2, 5]), st.integers(0, 6),
       st.integers(1, 4), st.integers(0, 10_000))
def test_trees_equal_cut_by_cut_growth(n, d, n_classes, max_depth, min_leaf, seed):
    rng = np.random.default_rng(seed)
    codes = rng.integers(0, 6, (n, d)).astype(np.uint8)
    w = rng.integers(1, 4, n).astype(float)
    y = rng.integers(0, n_classes or 50, n).astype(float)
    tree = grow(codes, w, np.ones(n), y, n_classes, d, max_depth, min_leaf, 2.0, rng)
    np.testing.assert_allclose(tree.value[tree.leaves(codes)], naive(codes, w, y, n_classes, max_depth, min_leaf))
    assert tree.depth.max() <= max_depth


def test_constant_features_are_passed_over():
    codes = np.zeros((8, 6), np.uint8)
    codes[:, 3] = range(8)
    y = np.arange(8.0)
    for seed in range(5):
        tree = grow(codes, np.ones(8), np.ones(8), y, 0, 1, 30, 1, 2.0, np.random.default_rng(seed))
        assert tree.value[tree.leaves(codes)].tolist() == y.tolist()


def test_bootstrap_weights():
    w = draws(np.arange(200_000), 7, 3)
    share = np.bincount(w, minlength=4)[:4] / len(w)
    np.testing.assert_allclose(share, [0.3679, 0.3679, 0.1839, 0.0613], atol=0.005)
    other = draws(np.arange(200_000), 7, 4)
    assert abs(np.corrcoef(w, other)[0, 1]) < 0.01
    assert n_picked("sqrt", 8) == 2 and n_picked("log2", 8) == 3 and n_picked(0.5, 8) == 4 and n_picked(99, 8) == 8


def test_tops_and_whole_trees_agree_in_quality(numbers):
    """Tables that fit a task, and the same table in many parts per tree: all holes filled, equally near."""
    holed = inject.mcar(numbers, 0.15, ["k"], 42, ["y", "label"])
    scores = []
    for settings_ in ({}, {"task_rows": 150, "sample_rows": 800}):
        filled = MissForest(["k"], n_estimators=20, max_iter=1, **settings_).fit_transform(holed)
        assert filled.where("y is null or label is null").count() == 0
        pair = evaluate.side_by_side(numbers, holed, filled, ["k"], ["y"])
        scores.append(evaluate.evaluate_target(pair, "y").first()["mean_nrmse"])
    assert max(scores) < 0.25 and abs(scores[0] - scores[1]) < 0.05


def _stage(df):
    return df.withColumns({"row": F.monotonically_increasing_id(), "hole": F.col("k") % 10 == 0})


def test_default_forest_learns_the_function(spark):
    df = _stage(spark.range(3000).select(
        F.col("id").alias("k"), (F.col("id") % 50).cast("double").alias("a"),
        ((F.col("id") * 7) % 31).cast("double").alias("b")).withColumn("y", F.col("a") * F.col("b")))
    cuts = quantile_cuts(df, ["a", "b"], 256)
    how = Growth(200, 42, "all", 30, 1, 1_000_000, 200_000)
    out = predicted(df, ["a", "b"], "y", "hole", "row", cuts, 0, 3000, how).join(df, "row")
    row = out.agg(F.count("*").alias("n"), F.avg(F.pow(F.col("prediction") - F.col("y"), 2)).alias("e"),
                  F.var_pop("y").alias("v")).first()
    assert row.n == 300 and row.e < 0.02 * row.v
    classes = predicted(df.withColumn("y", (F.col("a") > 20).cast("double") + (F.col("b") > 9).cast("double")),
                        ["a", "b"], "y", "hole", "row", cuts, 3, 3000, how).join(df, "row")
    assert classes.where("prediction != cast(a > 20 as int) + cast(b > 9 as int)").count() <= 3


def test_one_row_fills_half_of_the_table(spark):
    """Rows with equal codes are summed up before they are dealt, labels of all kinds included."""
    df = _stage(spark.range(4000, numPartitions=3).select(
        F.col("id").alias("k"), F.when(F.col("id") % 2 == 0, 1.0).otherwise(F.col("id").cast("double")).alias("a"),
        (F.col("id") % 7).cast("double").alias("y")))
    cuts = quantile_cuts(df, ["a"], 256)
    for n_classes in (0, 7):
        how = Growth(10, 1, "sqrt", 30, 1, 500, 1000)
        out = predicted(df, ["a"], "y", "hole", "row", cuts, n_classes, 4000, how)
        assert out.count() == 400
        assert out.where("prediction < 0 or prediction > 6 or prediction is null").count() == 0


def test_few_rows_and_wrong_settings(spark):
    df = spark.createDataFrame([(1, 1.0, 2.0), (2, 3.0, None), (3, None, 4.0)], "k int, a double, b double")
    out = {r.k: (r.a, r.b) for r in MissForest(["k"], n_estimators=5).fit_transform(df).collect()}
    assert out[1] == (1.0, 2.0) and out[2][0] == 3.0 and out[2][1] is not None and out[3][0] is not None
    with pytest.raises(ValueError):
        MissForest(["k"], max_bins=1000)


def test_rows_are_sent_once_per_top_not_per_tree(spark):
    df = _stage(spark.range(4000).select(
        F.col("id").alias("k"), (F.col("id") % 97).cast("double").alias("a"), F.col("id").cast("double").alias("y")))
    cuts = quantile_cuts(df, ["a"], 256)
    tops = _tops(df, ["a"], "y", "row", cuts, 0, 4000, Growth(40, 1, "sqrt", 30, 1, 500, 2000))
    deals = _deals(tops, 40, 2)
    assert len(tops) == 4 and len(deals) == 4
    assert sorted(t for _, trees in deals for t in trees) == list(range(40))
    assert [len(trees) for _, trees in _deals(tops[:1], 40, 1000)] == [1] * 40
