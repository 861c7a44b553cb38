import pytest
from pyspark.sql import functions as F

from lacunae.operators import encode, profile


@pytest.fixture
def typed(spark):
    return spark.createDataFrame(
        [(1, " 1 ", "a", 1.0, None), (2, "2.5", "1", None, None), (3, "", "b", float("nan"), "x"),
         (4, "4e1", "2", 4.0, None)],
        "customerID int, num string, mix string, v double, t string")


def test_coerce_numeric(typed):
    assert profile.numeric_share(typed) == {"num": 0.75, "mix": 0.5, "t": 0.0}
    out = profile.coerce_numeric(typed, threshold=0.6)
    assert dict(out.dtypes)["num"] == "double" and dict(out.dtypes)["mix"] == "string"
    assert [r["num"] for r in out.orderBy("customerID").collect()] == [1.0, 2.5, None, 40.0]
    assert dict(profile.coerce_numeric(typed, ["num"], 0.6).dtypes)["num"] == "string"


def test_nan_text_is_not_a_number(spark):
    df = spark.createDataFrame([("NaN",), ("nan",), ("1",)], "a string")
    assert profile.numeric_share(df)["a"] == pytest.approx(1 / 3)


def test_id_columns(spark):
    df = spark.createDataFrame([(1, 1, 1, 1, 1, 1)], "id int, PaID int, ID_x int, a_id_b int, v int, k int")
    assert profile.detect_id_columns(df, ["k", "nope"]) == {"id", "PaID", "ID_x", "a_id_b", "k"}
    assert profile.feature_columns(df, "v", {"id", "k"}) == ["PaID", "ID_x", "a_id_b"]


def test_targets(spark):
    df = spark.createDataFrame(
        [(1, None, 1.0, "x"), (2, None, None, None), (3, 3.0, None, None)],
        "k int, a double, b double, c string")
    assert profile.null_counts(df) == {"k": 0, "a": 2, "b": 2, "c": 2}
    assert profile.resolve_targets(df, ["k"]) == ["a"]
    assert profile.resolve_targets(df, ["k"], "all_missing_numeric") == ["a", "b"]
    assert profile.resolve_targets(df, ["k"], "explicit", ["c", "b", "k"]) == ["b"]
    with pytest.raises(ValueError):
        profile.resolve_targets(df, ["k"], "explicit")
    with pytest.raises(ValueError):
        profile.resolve_targets(df, ["k"], "some")
    full = df.fillna(0.0)
    assert profile.resolve_targets(full.select("k", "a"), ["k"]) == []


def test_prepare_pair(spark):
    full = spark.createDataFrame([(1, 2.0, "a")], "k int, v double, t string")
    a, b = profile.prepare_pair(full, full, ["k"], numeric_only=True)
    assert a.columns == b.columns == ["v"]
    with pytest.raises(ValueError):
        profile.prepare_pair(full, full.drop("v"))


def test_summary_and_scales(spark):
    df = spark.createDataFrame(
        [(1.0, 5.0, 0.0, 3.0, None)] * 9 + [(2.0, 5.0, 0.0, 9.0, None)],
        "a double, b double, c double, d double, e double")
    summary = profile.target_summary(df, "a")
    assert summary == {"min": 1.0, "q1": 1.0, "median": 1.0, "q3": 1.0, "max": 2.0,
                       "mean": pytest.approx(1.1)}
    assert profile.target_summary(df, "e") == {}
    scales = profile.numeric_scales(df, ["a", "b", "c", "d", "e"])
    # No IQR: sample deviation; no deviation: |median|; nothing: 1; no values: left out.
    assert scales["a"] == pytest.approx(0.31622776601683794)
    assert scales["b"] == 5.0 and scales["c"] == 1.0 and "e" not in scales


def test_split_observed(spark):
    df = spark.createDataFrame([(i, None if i % 2 else float(i)) for i in range(10)], "k int, v double")
    seen, todo = profile.split_observed(df, "v", 2, ["k"])
    assert seen.count() == 5 and [r["k"] for r in todo.collect()] == [1, 3]
    _, one = profile.split_observed(df, "v", pick=F.col("k") == 4)
    assert [r["k"] for r in one.collect()] == [4]
    with pytest.raises(ValueError):
        profile.split_observed(df, "v", 0)


def test_codes(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,), ("z",), ("b",)], "t string")
    known = ["a", "b"]
    assert encode.category_list(df, "t") == ["a", "b", "z"]
    got = df.select(encode.encode("t", known).alias("c"), "t").collect()
    assert {r["t"]: r["c"] for r in got} == {"a": 0.0, "b": 1.0, "z": -1.0, None: None}
    joined = encode.encode_by_join(df, "t", encode.category_codes(df.where("t != 'z'"), "t"), "c")
    assert {r["t"]: r["c"] for r in joined.collect()} == {"a": 0.0, "b": 1.0, "z": -1.0, None: None}
    back = spark.createDataFrame([(-3.0,), (0.4,), (0.5,), (1.5,), (9.0,)], "v double")
    labels = [r[0] for r in back.select(encode.decode(F.col("v"), known)).collect()]
    assert labels == ["a", "a", "a", "b", "b"]
    assert encode.category_lists(df, ["t"], limit=2) == {"t": None}
    found = encode.decode_by_join(back.withColumn("k", F.lit(1)), "v", encode.category_codes(
        df.where("t != 'z'"), "t"), 2, "label")
    assert sorted((r["v"], r["label"]) for r in found.collect()) == [
        (-3.0, "a"), (0.4, "a"), (0.5, "a"), (1.5, "b"), (9.0, "b")]


def test_codes_are_no_numbers(spark):
    texts = ["12d", "7F", "0x1p3", "1_000", "12", " -3.5e2 ", ".5", "5.", "inf", "NaN", "", "1e", "٣"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(profile.text_number(F.col("t"))).collect()]
    assert got == [None, None, None, None, 12.0, -350.0, 0.5, 5.0, float("inf"), None, None, None, None]
