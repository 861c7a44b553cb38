import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lacunae.llm.ann import CollisionIndex, nearest


def brute(rows, k, asks):
    good = {}
    for i, v in rows:
        if i is None or v is None or any(x is None or not math.isfinite(x) for x in v) or not any(v):
            continue
        good[i] = np.array(v, np.float64)
    out = {}
    for q, v in good.items():
        if asks(q):
            scored = sorted((-float(v @ w), i) for i, w in good.items() if i != q and len(w) == len(v))
            out[q] = [(i, -s) for s, i in scored[:k]]
    return out


def result(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(out[r.query_id])
    return out


def recall(got, expected):
    hits = sum(len({i for i, _ in got.get(q, [])} & {i for i, _ in e}) for q, e in expected.items())
    return hits / sum(len(e) for e in expected.values())


@pytest.mark.parametrize("block_rows", [8192, 100])
def test_recall_against_brute_force(spark, block_rows):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    expected = brute([(r.vec_id, r.embedding) for r in df.collect()], 20, lambda q: q % 20 == 0)
    got = result(nearest(df, F.col("vec_id") % 20 == 0, 20, block_rows=block_rows * 10))
    assert got.keys() == expected.keys() and all(len(x) == 20 for x in got.values())
    assert recall(got, expected) >= 0.93
    exact = {(q, i): s for q, e in expected.items() for i, s in e}
    for q, found in got.items():
        assert [(-s, i) for i, s in found] == sorted((-s, i) for i, s in found)
        assert all(abs(exact.get((q, i), s) - s) < 1e-9 for i, s in found)


def test_a_common_vector(spark):
    rng = np.random.default_rng(0)
    rows = [(i, [1.0, 2.0, 3.0] if i % 3 else rng.standard_normal(3).tolist()) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    expected = brute(rows, 20, lambda q: q % 10 == 0)
    got = result(nearest(df, F.col("vec_id") % 10 == 0, 20, verify_share=1.0))
    assert {q: [i for i, _ in x] for q, x in got.items()} == {q: [i for i, _ in x] for q, x in expected.items()}


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, None), (2, [0.0, 0.0]), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [None, 1.0]),
            (6, [0.5, 0.5]), (7, []), (8, [1.0, 2.0, 3.0]), (9, [1.0, 0.0]), (9, [1.0, 0.0]), (None, [1.0, 1.0])]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows],
                               "vec_id long, embedding array<double>, q int, score int")
    got = result(nearest(df, F.col("vec_id") % 2 == 0, 3))
    assert got == {0: [(9, 1.0), (6, 0.5)], 6: [(0, 0.5), (9, 0.5)]}
    assert nearest(df.limit(0), F.col("vec_id") % 2 == 0, 3).collect() == []


def test_windows_only_verify_a_part():
    rng = np.random.default_rng(1)
    data = rng.standard_normal((2000, 32))
    index = CollisionIndex(data, 128)
    q, at, score = index.search(data[:20], 10)
    best = np.sort(data[:20] @ data.T, axis=1)[:, ::-1][:, :10]
    got = [np.sort(score[q == i])[::-1][:10] for i in range(20)]
    assert np.mean([np.isin(np.round(b, 9), np.round(g, 9)).mean() for b, g in zip(best, got)]) > 0.9


@pytest.mark.parametrize("dims,cosine", [(256, 0.74), (256, 0.6), (256, 0.76), (64, 0.7), (32, 0.5)])
def test_recall_in_clusters(dims, cosine):
    """Many neighbours at nearly the same distance, just beyond the radius of a window."""
    rng = np.random.default_rng(0)
    centres = rng.standard_normal((64, dims))
    centres /= np.linalg.norm(centres, axis=1)[:, None]
    data = np.sqrt(cosine) * centres[np.arange(8192) % 64] + np.sqrt((1 - cosine) / dims) * rng.standard_normal(
        (8192, dims))
    data /= np.linalg.norm(data, axis=1)[:, None]
    q, at, _ = CollisionIndex(data, 128).search(data[:52], 21)
    best = np.argsort(-(data[:52] @ data.T), axis=1)[:, :21]
    assert np.mean([np.isin(best[i], at[q == i]).mean() for i in range(52)]) >= 0.9
