import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lacunae.llm.suffix_dedup import remove_repeats
from lacunae.llm.suffix_sort import common_prefixes, suffix_array


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 4), max_size=80))
def test_suffix_array(symbols):
    text = np.array([*symbols, 0])
    order = suffix_array(text)
    assert order.tolist() == sorted(range(len(text)), key=lambda i: tuple(text[i:]))


def test_suffix_array_of_words():
    rng = np.random.default_rng(0)
    words = [bytes(rng.integers(97, 123, 4).astype(np.uint8)) for _ in range(30)]
    data = b" ".join(words[i] for i in rng.integers(0, 30, 4000))
    text = np.concatenate([np.frombuffer(data, np.uint8).astype(np.int64), [0]])
    _, text = np.unique(text, return_inverse=True)
    order = suffix_array(text)[1:]
    assert order.tolist() == sorted(range(len(data)), key=lambda i: data[i:])
    shared = common_prefixes(np.frombuffer(data, np.uint8), order, 100)
    for a, b in list(zip(order, order[1:]))[::50]:
        n = 0
        while n < 100 and max(a, b) + n < len(data) and data[a + n] == data[b + n]:
            n += 1
        assert shared[b] == n


def brute(rows, length):
    """Every string of `length` bytes, first place wins; equal rows are one document."""
    order = sorted({(d is None, d or 0, t or "") for d, t in rows})
    seen, out = set(), {}
    places = {}
    for doc in order:
        body = doc[2].encode()
        covered = bytearray(len(body))
        for s in range(len(body) - length + 1):
            piece = body[s:s + length]
            if piece in seen:
                covered[s:s + length] = b"\1" * length
            seen.add(piece)
        runs = len([x for x in bytes(covered).split(b"\0") if x])
        out[doc] = (len(body), sum(covered), runs, hashlib.sha256(
            bytes(b for b, c in zip(body, covered) if not c)).hexdigest())
    del places
    return sorted(((d, *out[d is None, d or 0, t or ""]) for d, t in rows), key=str)


def result(df, **more):
    return sorted(((r[0], r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)
                   for r in remove_repeats(df, **more).collect()), key=str)


@pytest.mark.parametrize("hot", [20_000, 2, 0])
def test_same_as_brute_force(spark, hot):
    """Ids run in order of the batch here, so brute force needs no tie rule."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    more = spark.createDataFrame(
        [(1000, "ab" * 400), (1001, "x" * 300), (1002, "y" * 99 + "x" * 150), (1003, "x" * 99), (1004, "é" * 120)],
        docs.schema)
    docs = docs.union(more)
    expected = brute([tuple(r) for r in docs.collect()], 100)
    assert result(docs, hot_segments=hot) == expected
    assert sum(r[2] for r in expected) > 1000


@pytest.mark.parametrize("hot", [20_000, 1])
def test_repeats_in_small_alphabet(spark, hot):
    rng = np.random.default_rng(3)
    rows = [(i, "".join(rng.choice(list("abc"), rng.integers(0, 200)))) for i in range(60)]
    rows += [(100 + i, rows[i][1][20:] + rows[59 - i][1]) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert result(df, length=12, gram=5, hot_segments=hot) == brute(rows, 12)


def test_odd_rows(odd_documents, no_documents, spark):
    """No two different texts share an id here but the null one, which has equal parts under 100 bytes."""
    rows = [(r.doc_id, r.text) for r in odd_documents.collect()]
    assert result(odd_documents) == brute(rows, 100)
    assert remove_repeats(no_documents).collect() == []
    twice = spark.createDataFrame([(1, "q" * 50 + "r" * 100)] * 3, "doc_id long, text string")
    assert [r.n_removed for r in remove_repeats(twice).collect()] == [0, 0, 0]


def test_text_and_spans(spark):
    a = "".join(chr(97 + i * i * i % 997 % 26) for i in range(130))
    df = spark.createDataFrame([(1, a), (2, "start " + a + " end")], "doc_id long, text string")
    out = {r.doc_id: r for r in remove_repeats(df, length=60, with_text=True).collect()}
    assert bytes(out[2].kept) == b"start  end" and [tuple(s) for s in out[2].spans] == [(6, 136)]
    assert bytes(out[1].kept).decode() == a
