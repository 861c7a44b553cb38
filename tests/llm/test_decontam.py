import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lacunae.llm.decontam import FMIndex, WaveletMatrix, find_leaks, leak_report, suffix_order, without_spans

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(docs, items, width=10):
    windows = {}
    for item, text in items:
        w = words(text)
        for s in range(max(min(len(w), 1), len(w) - width + 1)):
            windows.setdefault(tuple(w[s:s + width]), set()).add("null" if item is None else str(item))
    sizes = {len(w) for w in windows}
    out = []
    for doc, text in docs:
        w = words(text)
        hit, found = set(), set()
        for size in sizes:
            for s in range(len(w) - size + 1):
                if owners := windows.get(tuple(w[s:s + size])):
                    hit.update(range(s, s + size))
                    found |= owners
        out.append((doc, len(w), len(hit), len(found),
                    hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def pairs(df):
    return [tuple(r) for r in df.collect()]


@pytest.mark.parametrize("block_words", [2_000_000, 100])
def test_same_as_brute_force(spark, block_words):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    items = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")
    got = pairs(leak_report(find_leaks(docs, items, block_words=block_words)))
    expected = brute(pairs(docs), pairs(items.select("item_id", "text")))
    assert sorted(got, key=str) == expected and any(r[5] for r in expected)


def test_odd_rows(spark, odd_documents, no_documents):
    items = spark.createDataFrame(
        [(1, "B, c!"), (2, ""), (3, None), (None, "TWO three four"), (4, "two THREE  four")],
        "item_id long, text string")
    got = pairs(leak_report(find_leaks(odd_documents, items)))
    assert sorted(got, key=str) == brute(pairs(odd_documents.select("doc_id", "text")), pairs(items))
    assert find_leaks(no_documents, items).collect() == []
    none = find_leaks(odd_documents, items.limit(0))
    assert none.count() == 12 and none.where("size(word_spans) > 0").count() == 0


def test_spans_are_cut_out(spark):
    docs = spark.createDataFrame([(1, "é One, two three. x"), (2, "none"), (3, None)], "doc_id int, text string")
    items = spark.createDataFrame([(7, "one two three")], "item_id int, text string")
    cut = find_leaks(docs, items)
    got = dict(pairs(cut.select("doc_id", without_spans(F.col("text"), F.col("word_spans")))))
    assert got == {1: "é  . x", 2: "none", 3: None}


def test_index_finds_all_places():
    rng = np.random.default_rng(0)
    text = np.concatenate([rng.integers(1, 5, 400), [0]])
    order = suffix_order(text)
    assert [tuple(text[i:]) for i in order] == sorted(tuple(text[i:]) for i in range(len(text)))
    index = FMIndex(text, 5)
    for size in (1, 2, 4):
        pattern = rng.integers(1, 5, (20, size))
        low, high = index.search(pattern, np.full(20, size))
        for p, a, b in zip(pattern, low, high):
            expected = [i for i in range(400) if tuple(text[i:i + size]) == tuple(p)]
            assert sorted(index.locate(np.arange(a, max(a, b))).tolist()) == expected


def test_ranks():
    rng = np.random.default_rng(1)
    s = rng.integers(0, 11, 300)
    tree = WaveletMatrix(s, 4)
    for c in range(11):
        at = np.arange(301)
        assert tree.rank(np.full(301, c), at).tolist() == [int((s[:i] == c).sum()) for i in at]
    symbol, rank = tree.symbol_rank(np.arange(300))
    assert symbol.tolist() == s.tolist()
    assert rank.tolist() == [int((s[:i] == s[i]).sum()) for i in range(300)]
