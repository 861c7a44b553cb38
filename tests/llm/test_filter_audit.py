import itertools
import math
import re
from collections import defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from lacunae.llm.filter_audit import COUNTS, Lattice, audit_filters
from pyspark.sql import functions as F


def failed(rows):
    """Row by row: the filters that each (id, text) fails."""
    least = {}
    for i, t in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    for i, t in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        yield {f for f, bad in {
            "A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w),
            "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search(r"[#$%&*|]", t)),
            "E": i is not None and i > least[t]}.items() if bad}


def brute(rows, labels):
    """All orders applied filter by filter. `rows`: (id, text, part)."""
    sets = list(failed([(i, t) for i, t, _ in rows]))
    out = {}
    for part in {p or "" for _, _, p in rows}:
        mine = [(i, s) for (i, _, p), s in zip(rows, sets, strict=True) if (p or "") == part]
        shapley = defaultdict(int)
        for order in itertools.permutations("ABCDE"):
            left = mine
            for k, f in enumerate(order):
                gone = [x for x in left if f in x[1]]
                now = [x for x in left if f not in x[1]]
                out[part, "".join(order), k + 1] = [
                    len(now), len(gone), sum(f in s for _, s in mine) - len(gone), sum(s == {f} for _, s in mine),
                    sum(labels.get(i, (0, 0))[0] == 1 for i, _ in gone),
                    sum(labels.get(i, (0, 0))[1] == 1 for i, _ in gone)]
                shapley[f] += len(gone)
                left = now
        for (p, order, k), values in out.items():
            if p == part:
                values.append(shapley[order[k - 1]])
    return out


def result(df):
    return {(r.part, r.filter_order, r.step): [r[c] for c in COUNTS] for r in df.collect()}


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 5), st.data())
def test_path_counts(n, data):
    lattice = Lattice(n)
    for before, f, uses in zip(lattice.before, lattice.filter, lattice.uses):
        assert uses == sum(order[len(seen := [g for g in order if before >> g & 1])] == f
                           and set(order[:len(seen)]) == set(seen) for order in lattice.orders)
    weights = np.array(data.draw(st.lists(st.integers(0, 9), min_size=len(lattice.uses), max_size=len(lattice.uses))))
    assert lattice.shapley(weights).sum() == weights[lattice.steps].sum()
    assert len(lattice.orders) == math.factorial(n)


def test_given_documents(spark, documents):
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    rows = [(r.doc_id, r.text, r.source) for r in documents.collect()]
    known = {r.doc_id: (r.quality, r.toxic) for r in labels.collect()}
    assert result(audit_filters(documents, labels)) == brute(rows, known)


def test_odd_rows(spark, no_documents):
    long = " ".join(f"w{i}" for i in range(30_000))
    texts = [(1, "a b", "x"), (2, None, None), (3, "", ""), (None, "a b", "x"), (4, "a b", "y"), (4, "a b", "x"),
             (1, "a b", "x"), (5, "AB " * 60, None), (6, long, "y"), (7, long, "y"), (None, None, None),
             (8, "$ 世界 é", "y"), (None, "", "x")]
    df = spark.createDataFrame(
        [(*t, 1, "m", 2, 3) for t in texts],
        "doc_id long, text string, source string, n int, mask string, digest int, step int")
    labels = spark.createDataFrame(
        [(1, 1, 0), (1, 0, None), (4, None, 1), (7, 1, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    known = {1: (1, 0), 4: (0, 1), 7: (1, 1)}
    assert result(audit_filters(df, labels)) == brute(texts, known)
    unlabelled = result(audit_filters(df))
    assert all(v[4:6] == [0, 0] for v in unlabelled.values()) and len(unlabelled) == 3 * 600
    assert audit_filters(no_documents, labels).collect() == []


def test_one_text_fills_the_table(spark):
    """Copies of one text are counted before they meet: a few rows per part go into the join by digest."""
    df = spark.range(3000, numPartitions=4).select(
        F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, F.lit("same")).otherwise(
            F.concat(F.lit("own "), F.col("id"))).alias("text"), (F.col("id") % 2).cast("string").alias("source"))
    rows = [(r.doc_id, r.text, r.source) for r in df.collect()]
    assert result(audit_filters(df)) == brute(rows, {})


def test_own_filters(spark):
    df = spark.createDataFrame([(1, "ab", "s"), (2, "ab", "s"), (3, "b", "s")], "doc_id int, text string, source string")
    found = audit_filters(df, filters={"X": F.col("body").contains("a"), "E": F.lit(False)})
    assert {k: v[:4] for k, v in result(found).items()} == {
        ("s", "XE", 1): [1, 2, 0, 1], ("s", "XE", 2): [1, 0, 1, 0],
        ("s", "EX", 1): [2, 1, 0, 0], ("s", "EX", 2): [1, 1, 1, 1]}
