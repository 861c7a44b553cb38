import pytest
from pyspark.sql import functions as F

from lacunae.operators import inject


def _holes(df, column):
    return {r["k"] for r in df.where(F.col(column).isNull()).select("k").collect()}


def test_mcar_rate_and_independence_of_partitioning(numbers):
    one = inject.mcar(numbers, 0.2, ["k"], 42, ["x", "label"])
    other = inject.mcar(numbers.repartition(7), 0.2, ["k"], 42, ["x", "label"])
    assert _holes(one, "x") == _holes(other, "x")
    assert 320 < len(_holes(one, "x")) < 480
    assert len(_holes(one, "x") & _holes(one, "label")) < 140
    assert not _holes(one, "y")
    assert _holes(one, "x") != _holes(inject.mcar(numbers, 0.2, ["k"], 43, ["x"]), "x")


def test_mcar_column_counts_exactly(numbers):
    part = numbers.withColumn("x", F.when(F.col("k") % 4 > 0, F.col("x")))
    holed = inject.mcar_column(part, 0.3333, "x", ["k"])
    assert len(_holes(holed, "x")) == 500 + int(0.3333 * 2000)
    with pytest.raises(ValueError):
        inject.mcar_column(part, 0.9, "x", ["k"])


def test_ranked_holes_follow_the_rank(numbers):
    holed = inject.mar(numbers, "x", "y", 0.2, ["k"])
    assert len(_holes(holed, "y")) == 400
    rows = holed.select("x", F.col("y").isNull().alias("m")).toPandas()
    share = rows.groupby(rows["x"] // 20)["m"].mean()
    # Weight grows with the rank: the top fifth is emptied far more often than the bottom one.
    assert share.iloc[-1] > 3 * share.iloc[0]
    assert share.is_monotonic_increasing


def test_ranked_holes_cap_and_limits(numbers, spark):
    few = numbers.withColumn("y", F.when(F.col("k") < 100, F.col("y")))
    assert inject.mnar(few, "y", 0.5, ["k"]).where("y is not null").count() == 0
    empty = numbers.withColumn("y", F.lit(None).cast("double"))
    assert inject.mnar(empty, "y", 0.5, ["k"]).count() == 2000
    assert not _holes(inject.mar(numbers, "x", "y", 0.0, ["k"]), "y")
    with pytest.raises(ValueError):
        inject.mar(numbers, "x", "x", 0.1, ["k"])


def test_rounding_of_the_sample_size(spark):
    five = spark.range(5).select(F.col("id").alias("k"), F.col("id").cast("double").alias("v"))
    # 0.5 * 5 = 2.5: truncated for the plain draw, half to even for the ranked one.
    assert len(_holes(inject.mcar_column(five, 0.5, "v", ["k"]), "v")) == 2
    assert len(_holes(inject.mnar(five, "v", 0.5, ["k"]), "v")) == 2
    assert len(_holes(inject.mnar(five, "v", 0.7, ["k"]), "v")) == 4


def test_excluding(numbers):
    holed = inject.mcar_excluding(numbers, 0.5, ["y", "label"], ["k"])
    assert not _holes(holed, "y") and not _holes(holed, "label") and _holes(holed, "x")
    same = inject.mcar_excluding(numbers, 0.5, numbers.columns, ["k"])
    assert same.columns == numbers.columns
