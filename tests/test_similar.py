import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lacunae.operators import inject, similar
from lacunae.operators.profile import numeric_scales


def _brute(pdf, scales, numeric, text, k):
    queries, refs = pdf[pdf["t"].isna()], pdf[pdf["t"].notna()].sort_values("k")
    out = {}
    for _, q in queries.iterrows():
        total, used = np.zeros(len(refs)), np.zeros(len(refs))
        for c in numeric:
            both = refs[c].notna().to_numpy() & (not pd.isna(q[c]))
            total += np.where(both, 1 / (1 + np.abs(q[c] - refs[c].to_numpy(float)) / scales[c]), 0)
            used += both
        for c in text:
            both = refs[c].notna().to_numpy() & (not pd.isna(q[c]))
            total += np.where(both, (refs[c] == q[c]).to_numpy(), 0)
            used += both
        with np.errstate(invalid="ignore"):
            score = np.where(used > 0, total / used, -np.inf)
        best = [i for i in np.argsort(-score, kind="stable")[:k] if np.isfinite(score[i])]
        out[q["k"]] = list(refs["k"].to_numpy()[best])
    return {q: r for q, r in out.items() if r}


@pytest.mark.parametrize("block_rows,cell_rows", [(20_000, 1_000), (37, 20)])
def test_matches_brute_force(numbers, block_rows, cell_rows):
    rows = inject.mcar(numbers, 0.1, ["k"], 3, ["x", "hot", "label"]).withColumn(
        "t", F.when(F.col("k") % 9 > 0, F.col("y")))
    features = ["x", "hot", "label"]
    got = similar.top_similar(
        rows.where("t is null"), rows, ["k"], "t", features, 3,
        block_rows=block_rows, cell_rows=cell_rows)
    found = (got.toPandas().sort_values(["k", "example_rank"]).groupby("k")["example_k"]
             .apply(list).to_dict())
    scales = numeric_scales(rows.where("t is not null"), ["x", "hot"])
    assert found == _brute(rows.toPandas(), scales, ["x", "hot"], ["label"], 3)


def test_one_column_with_many_bins(numbers):
    rows = numbers.select("k", F.when(F.col("k") % 13 > 0, F.col("x")).alias("x")).withColumn(
        "t", F.when(F.col("k") % 9 > 0, F.lit(1.0)))
    got = similar.top_similar(
        rows.where("t is null"), rows, ["k"], "t", ["x"], 2, cell_rows=5)
    found = (got.toPandas().sort_values(["k", "example_rank"]).groupby("k")["example_k"]
             .apply(list).to_dict())
    scales = numeric_scales(rows.where("t is not null"), ["x"])
    assert found == _brute(rows.toPandas(), scales, ["x"], [], 2)


def test_many_copies_keep_the_smallest_keys(numbers):
    rows = numbers.select("k", (F.col("k") % 4).alias("a"), "label").withColumn(
        "t", F.when(F.col("k") % 50 > 0, F.lit(1.0)))
    got = similar.top_similar(
        rows.where("t is null"), rows, ["k"], "t", ["a", "label"], 2, cell_rows=50).toPandas()
    found = got.sort_values(["k", "example_rank"]).groupby("k")["example_k"].apply(list).to_dict()
    scales = numeric_scales(rows.where("t is not null"), ["a"])
    assert found == _brute(rows.toPandas(), scales, ["a"], ["label"], 2)


def test_excludes_the_row_itself_and_edge_cases(numbers):
    rows = numbers.select("k", "x", F.lit(1.0).alias("t"))
    got = similar.top_similar(rows.where("k < 20"), rows, ["k"], "t", ["x"], 1)
    assert got.count() == 20 and got.where("k = example_k").count() == 0
    assert similar.top_similar(rows, rows, ["k"], "t", ["x"], 0).count() == 0
    assert similar.top_similar(rows, rows, ["k"], "t", ["t"], 2).count() == 0


def _ranges(tree, refs):
    """Cell ranges as `top_similar` gathers them."""
    cell = tree.leaves(refs)
    stats = pd.DataFrame({"_cell": np.unique(cell), "_n": np.unique(cell, return_counts=True)[1]})
    for c in tree.columns:
        by = refs[c].groupby(cell)
        stats[f"{c}__n"] = by.count().to_numpy()
        if c in tree.text:
            bits = refs[c].map(lambda v, c=c: 0 if v is None or v != v else 1 << tree.codes[c].get(v, similar.KNOWN_VALUES))
            stats[f"{c}__kinds"] = bits.groupby(cell).agg(lambda s: np.bitwise_or.reduce(s.to_numpy(np.int64))).to_numpy()
        else:
            stats[f"{c}__lo"], stats[f"{c}__hi"] = by.min().to_numpy(), by.max().to_numpy()
    tree.measure(stats)
    return cell


def _scores(refs, q, scales, numeric, text):
    total, used = np.zeros(len(refs)), np.zeros(len(refs))
    for c in numeric:
        both = refs[c].notna().to_numpy() & (not pd.isna(q[c]))
        total += np.where(both, 1 / (1 + np.abs(q[c] - refs[c].to_numpy(float)) / scales[c]), 0)
        used += both
    for c in text:
        both = refs[c].notna().to_numpy() & (not pd.isna(q[c]))
        total += np.where(both, (refs[c] == q[c]).to_numpy(), 0)
        used += both
    with np.errstate(invalid="ignore"):
        return np.where(used > 0, total / used, -np.inf)


def test_bounds_hold(numbers):
    """No row may score above the bound of any node above it."""
    pdf = inject.mcar(numbers, 0.2, ["k"], 3, ["x", "label"]).select("k", "x", "hot", "label").toPandas()
    refs, queries = pdf.iloc[:600].reset_index(drop=True), pdf.iloc[600:700].reset_index(drop=True)
    scales = {"x": 25.0, "hot": 3.0}
    tree = similar.CellTree(refs, ["x", "hot"], ["label"], scales, 40)
    cell = _ranges(tree, refs)
    assert len(np.unique(cell)) == 40
    parent = {c: node for node in range(len(tree.left)) if tree.left[node] >= 0
              for c in (tree.left[node], tree.left[node] + 1)}
    values, there = tree.matrix(queries)
    for i, (_, q) in enumerate(queries.iterrows()):
        score = _scores(refs, q, scales, ["x", "hot"], ["label"])
        best = np.full(len(tree.left), -np.inf)
        for node, s in zip(cell.tolist(), score):
            while node is not None:
                best[node] = max(best[node], s)
                node = parent.get(node)
        at = np.arange(len(best))
        bound = tree.upper(np.repeat(values[i:i + 1], len(at), 0), np.repeat(there[i:i + 1], len(at), 0), at)
        assert (best <= bound + 1e-12).all()


def _wide(n):
    """Ten mixed columns of three loose kinds of rows, some cells missing."""
    rng = np.random.default_rng(5)
    kind = rng.integers(0, 12, n)
    out = pd.DataFrame({"k": np.arange(n)})
    for i in range(5):
        out[f"x{i}"] = rng.normal(0, 1, 12)[kind] * 10 + rng.normal(0, 1, n)
    for i in range(5):
        own = rng.integers(0, 6, 12)[kind]
        out[f"s{i}"] = pd.Series(np.where(rng.random(n) < 0.9, own, rng.integers(0, 200, n))).astype(str)
    out.loc[rng.random(n) < 0.05, "x1"] = np.nan
    out.loc[rng.random(n) < 0.05, "s1"] = None
    out["t"] = np.where(np.arange(n) % 40 == 0, np.nan, 1.0)
    return out


def test_ten_columns_are_pruned():
    """Scored pairs stay far below queries times rows, and no better row is missed."""
    pdf = _wide(20_000)
    numeric, text = [f"x{i}" for i in range(5)], [f"s{i}" for i in range(5)]
    refs, queries = pdf[pdf.t.notna()].reset_index(drop=True), pdf[pdf.t.isna()].reset_index(drop=True)
    scales = {c: float(refs[c].std()) for c in numeric}
    tree = similar.CellTree(refs.sample(2400, random_state=1), numeric, text, scales, 200)
    cell, own = _ranges(tree, refs), tree.leaves(queries)
    size = np.bincount(cell, minlength=len(tree.left))
    scored, k = size[own].sum(), 3
    floor = np.full(len(queries), -np.inf)
    every = [_scores(refs, q, scales, numeric, text) for _, q in queries.iterrows()]
    for i, score in enumerate(every):
        mine = np.sort(score[cell == own[i]])
        floor[i] = mine[-k] if len(mine) >= k else -np.inf
    row, reached = tree.reachable(queries, own, floor)
    scored += size[reached].sum()
    assert scored < 0.15 * len(queries) * len(refs)
    for i, score in enumerate(every):
        seen = np.isin(cell, np.append(reached[row == i], own[i]))
        assert np.sort(score)[-k] == np.sort(score[seen])[-k]


def test_ten_columns_match_brute_force(spark):
    pdf = _wide(3000)
    numeric, text = [f"x{i}" for i in range(5)], [f"s{i}" for i in range(5)]
    rows = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), "k long, " + ", ".join(
        [f"{c} double" for c in numeric] + [f"{c} string" for c in text]) + ", t double")
    got = similar.top_similar(rows.where("t is null"), rows, ["k"], "t", numeric + text, 3, cell_rows=60)
    found = (got.toPandas().sort_values(["k", "example_rank"]).groupby("k")["example_k"].apply(list).to_dict())
    scales = numeric_scales(rows.where("t is not null"), numeric)
    assert found == _brute(pdf, scales, numeric, text, 3)
