import numpy as np
import pytest
from pyspark.sql import functions as F

from lacunae.operators import order


@pytest.mark.parametrize("small", [0, 10**6])
@pytest.mark.parametrize("column", ["x", "hot"])
def test_exact_quantiles_match_pandas(numbers, column, small):
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.99, 1.0]
    got = order.exact_quantiles(numbers, [column], probs, small=small)[column]
    want = numbers.select(column).toPandas()[column].quantile(probs)
    np.testing.assert_allclose(got, want, rtol=1e-12)


def test_quantiles_of_an_empty_column(spark):
    df = spark.createDataFrame([(None,), (None,)], "v double")
    assert order.exact_quantiles(df, ["v"], [0.5]) == {"v": None}


def test_pick_ranks_narrows_over_several_passes(numbers):
    values = sorted(r[0] for r in numbers.select("hot").collect())
    ranks = [0, 5, 700, 1999]
    got = order.pick_ranks(numbers, {"hot": ranks}, collect_limit=3, buckets=4)["hot"]
    assert [got[r].value for r in ranks] == [values[r] for r in ranks]
    assert got[700].equal == values.count(values[700])
    assert got[700].below == sum(v < values[700] for v in values)


def test_ranks_with_infinite_and_huge_values(spark):
    inf = float("inf")
    values = [-inf, -1.7e308, -3.0, 0.0, 1e-300, 2.0, 1.7e308, inf, inf]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = order.pick_ranks(df, {"v": range(9)}, collect_limit=1, buckets=4)["v"]
    assert [got[i].value for i in range(9)] == values


def test_smallest_breaks_ties_by_the_next_key(numbers):
    rows = numbers.select("k", "hot")
    for k in (0, 1, 57, 400, 2000):
        chosen = rows.where(order.smallest(rows, ["hot", "k"], k))
        want = sorted((r["hot"], r["k"]) for r in rows.collect())[:k]
        assert sorted((r["hot"], r["k"]) for r in chosen.collect()) == want


def test_position_splits_a_hot_value(numbers):
    bucketed = order.order_buckets(numbers.select("hot", "k"), ["hot", "k"], 2000, 100)
    sizes = [r["count"] for r in bucketed.groupBy("_b").count().collect()]
    assert max(sizes) < 300  # the hot value alone has 800 rows
    placed = order.with_position(numbers.select("hot", "k"), ["hot", "k"], bucket_rows=100)
    pdf = placed.toPandas().sort_values(["hot", "k"]).reset_index(drop=True)
    assert (pdf["position"] == pdf.index).all()


@pytest.mark.parametrize("broadcast_rows", [10, 10**5])
def test_average_rank_matches_pandas(numbers, broadcast_rows):
    with_nulls = numbers.select("k", F.when(F.col("k") % 11 > 0, F.col("hot")).alias("v"))
    ranked = order.with_average_rank(
        with_nulls, "v", bucket_rows=20, broadcast_rows=broadcast_rows).toPandas()
    assert len(ranked) == 2000
    want = ranked["v"].rank(method="average")
    np.testing.assert_allclose(ranked["rank"], want, equal_nan=True)


@pytest.mark.parametrize("bucket_rows", [50, 10**6])
def test_running_totals_per_group(numbers, bucket_rows):
    # One label holds most rows.
    rows = numbers.select("k", F.when(F.col("k") % 5 == 0, F.col("label")).otherwise(
        F.lit("z")).alias("g"), F.col("k").alias("v"))
    got = order.running_totals(
        rows, ["g"], ["k"], {"s": F.col("v")}, bucket_rows).toPandas().sort_values("k")
    assert (got["s"] == got.groupby("g")["v"].cumsum()).all()


def test_running_maximum(numbers):
    rows = numbers.select("k", F.when(F.col("k") % 97 == 5, F.col("k")).alias("v"))
    got = order.running_totals(
        rows, [], ["k"], {"m": F.col("v")}, 64, how="max").toPandas().sort_values("k")
    want = got["v"].cummax().ffill()
    np.testing.assert_allclose(got["m"].astype(float), want.astype(float), equal_nan=True)


@pytest.mark.parametrize("column", ["x", "hot"])
@pytest.mark.parametrize("bucket_rows", [10_000, 60])
def test_ranks_in_place_equal_the_joined_ones(numbers, column, bucket_rows):
    """One bucket and many, with a value on 40 % of the rows, and nulls."""
    rows = numbers.select("k", F.when(F.col("k") % 7 > 0, F.col(column)).alias("v"), F.md5(
        F.col("k").cast("string")).alias("d"))
    n = rows.where("v is not null").count()
    got = order.with_rank_in_place(rows, "v", "d", n, bucket_rows=bucket_rows)
    want = order.with_average_rank(rows, "v", "want")
    assert got.columns == ["k", "v", "d", "rank"] and got.count() == 2000
    assert got.join(want.select("k", "want"), "k").where("not (rank <=> want)").count() == 0
