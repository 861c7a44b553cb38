import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lacunae.operators import evaluate, inject
from lacunae.operators.dae import DenoisingImputer
from lacunae.operators.forest import MissForest, convergence_delta, should_stop
from lacunae.operators.gram import Gram, _by_batch, _by_expression, grams
from lacunae.operators.mice import Mice, evidence_ridge
from lacunae.operators.registry import build_imputer
from lacunae.operators.simple import FillModel, MeanMode, MedianMode


def test_mean_median_mode(spark):
    df = spark.createDataFrame(
        [(1, 1.0, "b", None, None), (2, None, "a", None, None), (3, 2.0, "b", None, None),
         (4, 6.0, "a", None, None), (5, None, None, None, None)],
        "k int, v double, t string, none string, empty double")
    mean = MeanMode(["k"]).fit(df)
    row = mean.transform(df).where("k = 5").first()
    assert (row["v"], row["t"], row["none"], row["empty"]) == (3.0, "a", "missing", None)
    assert MedianMode(["k"]).fit_transform(df).where("k = 5").first()["v"] == 2.0
    again = FillModel.from_json(mean.to_json())
    assert again.transform(df).where("k = 5").first()["v"] == 3.0


def test_grams_agree(numbers):
    staged = numbers.withColumns({"m1": F.col("k") % 3 == 0, "m2": F.col("k") % 2 == 0})
    columns = ["x", "hot", "y"]
    a = _by_expression(staged, columns, ["m1", "m2"])
    b = _by_batch(staged, columns, ["m1", "m2"])
    np.testing.assert_allclose(a, b, rtol=1e-10)
    x = staged.where("m2").select(*columns).toPandas().to_numpy()
    gram = grams(staged, columns, ["m1", "m2"])[1]
    np.testing.assert_allclose(gram.products, x.T @ x, rtol=1e-10)
    np.testing.assert_allclose(gram.centred(), (x - x.mean(0)).T @ (x - x.mean(0)), rtol=1e-6)


def test_evidence_ridge_solves_the_shrunk_system():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(500, 3)) * [1, 5, 0.1] + [3, -2, 8]
    y = x @ [1.0, -0.5, 4.0] + 2 + rng.normal(size=500) * 0.3
    z = np.column_stack([x, y])
    ridge = evidence_ridge(Gram(500, z.sum(0), z.T @ z), ["a", "b", "c"], [0] * 4)
    exact = np.linalg.lstsq(np.column_stack([x, np.ones(500)]), y, rcond=None)[0]
    np.testing.assert_allclose(ridge.weights, exact[:3], atol=0.05)
    assert ridge.noise == pytest.approx(0.09, rel=0.2)
    assert ridge.level == pytest.approx(y.mean())
    # At the fixed point the weights solve the ridge system for the estimated precisions.
    xc, yc = x - x.mean(0), y - y.mean()
    implied = (xc.T @ yc - xc.T @ xc @ ridge.weights) / ridge.weights
    np.testing.assert_allclose(implied, implied[0], rtol=1e-4)


def _score(full, holed, filled, target="y"):
    pair = evaluate.side_by_side(full, holed, filled, ["k"], [target])
    return evaluate.checked_target_score(pair, target)


@pytest.fixture(scope="module")
def one_target(numbers):
    return inject.mcar_column(numbers, 0.2, "y", ["k"])


@pytest.mark.parametrize("key,options,limit", [
    ("meanmode", {}, 1.2), ("medianmode", {}, 1.2), ("mice", {}, 0.05),
    ("missforest", {"n_estimators": 10, "max_depth": 8}, 0.35)])
def test_quality_on_one_target(numbers, one_target, key, options, limit):
    filled = build_imputer(key, 42, ["k"], **options).fit_transform(one_target)
    score = _score(numbers, one_target, filled)
    assert score["n_masked_target"] == 400 and score["n_unfilled"] == 0
    assert score["mean_nrmse"] < limit
    # Observed cells are untouched.
    kept = one_target.where("y is not null").select("k", F.col("y").alias("was"))
    assert filled.join(kept, "k").where("y != was").count() == 0


def test_mice_fills_everything_and_decodes(numbers):
    holed = inject.mcar(numbers, 0.15, ["k"], 42)
    mice = Mice(["k"])
    filled = mice.fit_transform(holed)
    nulls = filled.select(*[F.count_if(F.col(c).isNull()).alias(c) for c in filled.columns]).first()
    assert sum(nulls) == 0
    assert {r[0] for r in filled.select("label").distinct().collect()} <= {"a", "b", "c"}
    assert _score(numbers, holed, filled)["mean_nrmse"] < 0.6
    # A fitted model gives the same result on the same table.
    again = mice.fit(holed).transform(holed).select("k", F.col("y").alias("y2"))
    worst = filled.join(again, "k").agg(F.max(F.abs(F.col("y") - F.col("y2")))).first()[0]
    assert worst < 1e-6


def test_many_categories_are_joined_with_the_same_result(numbers, monkeypatch):
    from lacunae.operators import forest, mice, modelling

    holed = inject.mcar(numbers, 0.1, ["k"], 42, ["y", "label"])
    few = Mice(["k"]).fit_transform(holed)

    def joined(df, keys):
        return modelling.layout(df, keys, limit=2)

    monkeypatch.setattr(mice, "layout", joined)
    many = Mice(["k"]).fit_transform(holed)
    both = few.join(many.select("k", F.col("y").alias("y2"), F.col("label").alias("l2")), "k")
    assert many.columns == holed.columns and both.count() == 2000
    assert both.where("label != l2 or abs(y - y2) > 1e-6 or l2 is null").count() == 0
    monkeypatch.setattr(forest, "layout", joined)
    grown = MissForest(["k"], n_estimators=4, max_depth=4, max_iter=1).fit_transform(holed)
    assert grown.where("y is null or label is null").count() == 0


def test_sums_by_pattern_equal_passes_over_rows(numbers, monkeypatch):
    """The same fills whether sweeps run on sums per pattern of holes or over the rows."""
    from lacunae.operators import mice

    holed = inject.mcar(numbers, 0.2, ["k"], 42)
    by_sums = Mice(["k"]).fit(holed)
    a = by_sums.transform(holed)
    monkeypatch.setattr(mice, "MATRIX_CELLS", 0)
    by_rows = Mice(["k"]).fit(holed)
    b = by_rows.transform(holed).select("k", *[F.col(c).alias(f"{c}_b") for c in ("x", "hot", "y", "label")])
    assert len(by_sums.steps) == len(by_rows.steps) > 4
    worst = a.join(b, "k").agg(F.max(F.greatest(*[F.abs(F.col(c) - F.col(f"{c}_b")) for c in ("x", "hot", "y")])),
                               F.count_if(F.col("label") != F.col("label_b"))).first()
    assert worst[0] < 1e-6 and worst[1] == 0


def test_posterior_draws_of_many_columns(numbers):
    """All draws of a regression come from one pass; each scatters and their mean is nearer than one."""
    holed = inject.mcar(numbers, 0.15, ["k"], 42)
    one = Mice(["k"], sample_posterior=True, max_iter=3).fit_transform(holed)
    five = Mice(["k"], sample_posterior=True, n_imputations=5, max_iter=3).fit_transform(holed)
    nulls = five.select([F.count_if(F.col(c).isNull()).alias(c) for c in five.columns]).first()
    assert sum(nulls) == 0
    assert _score(numbers, holed, five)["mean_rmse"] < _score(numbers, holed, one)["mean_rmse"]


def test_mice_posterior_mean_is_close_and_seeded(numbers, one_target):
    plain = _score(numbers, one_target, Mice(["k"]).fit_transform(one_target))
    drawn = Mice(["k"], sample_posterior=True, n_imputations=4)
    assert drawn.name == "MICE posterior mean (m=4)"
    a = _score(numbers, one_target, drawn.fit_transform(one_target))
    b = _score(numbers, one_target.repartition(5), drawn.fit_transform(one_target.repartition(5)))
    assert a["mean_rmse"] == pytest.approx(b["mean_rmse"], rel=1e-9)
    # The noise of a mean of four draws adds a quarter of the error variance.
    assert a["mean_rmse"] == pytest.approx(plain["mean_rmse"] * math.sqrt(1.25), rel=0.08)


def test_forest_stops_and_keeps_history(numbers):
    holed = inject.mcar(numbers, 0.1, ["k"], 42, ["y", "label"])
    model = MissForest(["k"], n_estimators=5, max_depth=5, max_iter=3).fit(holed)
    filled = model.transform(holed)
    assert filled.where("y is null or label is null").count() == 0
    assert 1 <= model.n_iter <= 3 and model.history[0]["iteration"] == 1
    assert {"numeric_delta", "categorical_delta", "stopped"} <= set(model.history[0])


def test_forest_fills_empty_columns_with_constants(numbers):
    holed = inject.mcar_column(numbers, 0.1, "y", ["k"]).withColumns({
        "none": F.lit(None).cast("double"), "word": F.lit(None).cast("string")})
    filled = MissForest(["k"], n_estimators=3, max_depth=3).fit_transform(holed)
    assert {tuple(r) for r in filled.select("none", "word").distinct().collect()} == {
        (0.0, "missing")}
    assert filled.where("y is null").count() == 0


def test_convergence_delta(spark):
    df = spark.createDataFrame(
        [(1.0, 2.0, True, 0.0, 1.0), (3.0, 3.0, True, 1.0, 1.0), (9.0, 0.0, False, 0.0, 1.0)],
        "old__v double, now__v double, m boolean, old__t double, now__t double")
    numeric, text = convergence_delta(df, {"v": "m"}, {"t": "m"})
    assert numeric == pytest.approx(1 / 13) and text == 0.5
    assert math.isnan(convergence_delta(df, {}, {"t": "m"})[0])
    zero = spark.createDataFrame([(1.0, 0.0, True)], "old__v double, now__v double, m boolean")
    assert convergence_delta(zero, {"v": "m"})[0] == pytest.approx(1e12)
    assert should_stop((2.0, math.nan), (1.0, math.inf))
    assert not should_stop((2.0, 0.1), (1.0, 0.2)) and not should_stop((math.nan,) * 2, (1, 1))


def test_denoising_matches_random_copies(numbers):
    """The closed form is the limit of a regression on many corrupted copies."""
    holed = inject.mcar(numbers.drop("label"), 0.1, ["k"], 42, ["y", "x"])
    model = DenoisingImputer(["k"], corruption=0.3).fit(holed)
    raw = holed.orderBy("k").toPandas()[model.columns].to_numpy()
    seen = ~np.isnan(raw)
    z = np.where(seen, (raw - model.mean) / model.scale, 0.0)
    target = model.columns.index("y")
    rng = np.random.default_rng(0)
    rows, out = [], []
    for _ in range(200):
        keep = rng.random(z.shape) >= 0.3
        noisy = np.where(keep, z, 0.0)
        noisy[:, target] = 0.0
        marks = seen[:, [model.columns.index(c) for c in ("x", "y")]]
        part = np.column_stack([np.delete(noisy, target, 1), marks[:, :1], np.ones(len(z))])
        rows.append(part[seen[:, target]])
        out.append(z[seen[:, target], target])
    want = np.linalg.lstsq(np.vstack(rows), np.concatenate(out), rcond=None)[0]
    values, marks, level = model.weights[target]
    others = [c for c in model.columns if c != "y"]
    np.testing.assert_allclose([values[c] for c in others], want[:2], atol=0.02)
    assert marks["x"] == pytest.approx(want[2], abs=0.05)


def test_denoising_fills_and_refuses(numbers):
    holed = inject.mcar_column(numbers.drop("label"), 0.2, "y", ["k"])
    filled = DenoisingImputer(["k"]).fit_transform(holed)
    assert _score(numbers, holed, filled)["mean_nrmse"] < 0.3
    with pytest.raises(ValueError):
        DenoisingImputer(["k"]).fit(numbers)
    model = DenoisingImputer(["k"]).fit(holed)
    with pytest.raises(ValueError):
        model.transform(holed.select("k", "y", "x", "hot"))


def test_registry(numbers):
    with pytest.raises(ValueError):
        build_imputer("knn")
    assert build_imputer("dae", 7, ["k"]).seed == 7


def test_stream_gives_the_batch_result(spark, numbers, tmp_path):
    from lacunae.streaming.fill import fill_stream, read_stream

    holed = inject.mcar(numbers, 0.2, ["k"], 42, ["x", "label"])
    source = str(tmp_path / "in")
    holed.repartition(3).write.parquet(source)
    model = MeanMode(["k"]).fit(holed)
    query = fill_stream(read_stream(spark, source, holed.schema), model,
                        str(tmp_path / "out"), str(tmp_path / "state"))
    query.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(got.collect()) == sorted(model.transform(holed).collect())


@pytest.mark.parametrize("kinds", [150, 3000])
def test_forest_on_many_categories(spark, kinds):
    """More classes than the forest's own limit of 100, as literals and as a joined table."""
    rows = [(i, float(i % kinds), f"c{i % kinds:05d}" if i % 17 else None) for i in range(2 * kinds)]
    df = spark.createDataFrame(rows, "k long, x double, label string")
    out = MissForest(["k"], n_estimators=2, max_depth=3).fit_transform(df)
    assert out.where("label is null").count() == 0
    assert out.select("label").distinct().count() <= kinds


def test_posterior_draws_need_keys(numbers):
    holed = inject.mcar_column(numbers.select("k", "x", "y"), 0.1, "y", ["k"]).drop("k")
    with pytest.raises(ValueError):
        Mice(sample_posterior=True).fit_transform(holed)


def test_bent_layers_learn_what_one_layer_cannot(numbers):
    rows = numbers.select("k", "x", "hot", (F.col("x") * F.col("x") / 100).alias("y"))
    holed = inject.mcar_column(rows, 0.2, "y", ["k"])
    one, two, three = (_score(rows, holed, DenoisingImputer(["k"], layers=n).fit_transform(holed)) for n in (1, 2, 3))
    assert one["n_unfilled"] == two["n_unfilled"] == three["n_unfilled"] == 0
    assert two["mean_rmse"] < 0.8 * one["mean_rmse"] and three["mean_rmse"] < 0.8 * one["mean_rmse"]
    again = DenoisingImputer(["k"], layers=2).fit_transform(holed.repartition(3))
    assert _score(rows, holed, again)["mean_rmse"] == pytest.approx(two["mean_rmse"], rel=1e-6)
    with pytest.raises(ValueError):
        DenoisingImputer(["k"], layers=0)


def test_codes_follow_the_sorted_order(spark):
    """Ranges and places number all values, one on half of the rows included, without gaps."""
    from lacunae.operators import encode

    df = spark.range(6000).select(F.when(F.col("id") % 2 == 0, F.lit("hot")).when(F.col("id") % 7 > 0, F.concat(
        F.lit("é"), F.col("id") % 2500)).alias("v"))
    codes = encode.category_codes(df, "v")
    got = [r["value"] for r in codes.orderBy("code").collect()]
    assert got == sorted(got, key=lambda x: x.encode()) and len(got) == df.select("v").dropna().distinct().count()
    assert sorted(r["code"] for r in codes.collect()) == list(map(float, range(len(got))))
    coded = encode.encode_by_join(df, "v", codes, "c")
    assert coded.where("v is null").where("c is not null").count() == 0
    assert coded.where("v = 'hot'").select("c").distinct().count() == 1
    assert encode.category_codes(df.where("false"), "v").count() == 0


def test_facts_read_a_kept_table(numbers):
    """The holes are drawn once, not again in each pass of an imputer."""
    from lacunae.catalog.models import _facts
    found = _facts(numbers.select("k", "y"), ["k"], ["y"], MeanMode, ["y"], [])
    assert "md5" not in found._jdf.queryExecution().optimizedPlan().toString()
    row = found.first()
    assert (row["n_rows"], row["n_changed"], row["n_unfilled"]) == (2000, 0, 0) and row["n_holes"] > 0
