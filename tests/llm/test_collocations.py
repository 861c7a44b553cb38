import re
from collections import Counter, defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lacunae.llm.collocations import MisraGries, Places, collocations, frequent_phrases


def counted(rows, longest=5):
    """Counts of all phrases per language, and of all words."""
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for m in range(1, longest + 1):
                f[lang].update(" ".join(w[i:i + m]) for i in range(len(w) - m + 1))
    return f, n


def brute(rows, threshold, longest=5, cover=100, top=None):
    counts, totals = counted(rows, longest)
    out = []
    for lang, f in counts.items():
        n = totals[lang]
        found = {p: a for p, a in f.items() if " " in p and a >= threshold}
        covered = defaultdict(int)
        for p, a in found.items():
            w = p.split(" ")
            for m in range(2, len(w)):
                for i in range(len(w) - m + 1):
                    q = " ".join(w[i:i + m])
                    covered[q] = max(covered[q], a)
        scored = []
        for p, a in found.items():
            w = p.split(" ")
            cuts = []
            for k in range(1, len(w)):
                left, right = f[" ".join(w[:k])], f[" ".join(w[k:])]
                cuts.append((1000 * a * n // (left * right), k, left, right))
            score, _, left, right = min(cuts)
            if not (p in covered and 100 * covered[p] >= cover * a):
                scored.append((-score, -a, p.encode(), left, right))
        for rank, (score, a, p, left, right) in enumerate(sorted(scored)[:top]):
            out.append((lang, rank + 1, p.decode(), -a, left, right, n, -score))
    return sorted(out)


def result(df):
    return sorted(tuple(r) for r in df.collect())


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.tuples(st.integers(0, 60), st.integers(1, 9)), max_size=40), max_size=8), st.integers(1, 30))
def test_no_frequent_key_is_lost(parts, threshold):
    """Summaries of parts, merged: whatever the split, every key with the threshold survives."""
    mass = sum(c for part in parts for _, c in part)
    whole = MisraGries(mass // threshold + 1)
    true = Counter()
    for part in parts:
        own = MisraGries(mass // threshold + 1)
        for key, c in part:
            own.add(np.array([key], np.uint32), np.array([c]))
            own.settle()
            true[key] += c
        whole.merge(own)
    found = set(whole.at_least(threshold).tolist())
    assert {k for k, c in true.items() if c >= threshold} <= found
    assert len(whole.keys) <= whole.capacity and whole.error < threshold
    assert all(true[k] - whole.error <= c <= true[k] for k, c in zip(whole.keys.tolist(), whole.counts.tolist()))


def test_places_are_dealt_in_order():
    keys = np.sort(np.random.default_rng(1).integers(0, 1 << 63, 5000).astype(np.uint64) * np.uint64(2))
    for parts in (1, 7, 1000):
        places = Places(parts)
        part = places.part(keys)
        assert (np.diff(part.astype(int)) >= 0).all() and part.max() == parts - 1
        at = places.bit(part, keys & np.uint64(0xFFFFFFFF))
        bitmap = np.zeros(parts * places.bits // 8, np.uint8)
        for x in at.tolist():
            bitmap[x >> 3] |= 128 >> (x & 7)
        assert places.passed(bitmap, keys).all()
        assert (at // np.uint64(places.bits) == part).all()


def test_given_documents(spark, documents):
    rows = [(r.lang, r.text) for r in documents.select("lang", "text").collect()]
    assert result(collocations(documents, threshold=20, top=None)) == brute(rows, 20)
    assert result(collocations(documents, threshold=40, top=5, cover_percent=60)) == brute(rows, 40, 5, 60, 5)
    assert result(collocations(documents, longest=2, threshold=30, top=9)) == brute(rows, 30, 2, top=9)


def test_counts_are_exact(spark, documents):
    rows = [(r.lang, r.text) for r in documents.select("lang", "text").collect()]
    counts, totals = counted(rows)
    expected = {(lang, p, c) for lang, f in counts.items() for p, c in f.items() if c >= 25}
    expected |= {(lang, "", n) for lang, n in totals.items()}
    assert {(r.lang, r.phrase, r.f) for r in frequent_phrases(documents, threshold=25).collect()} == expected


def test_odd_rows(spark, no_documents):
    texts = [("en", "A  b\tc. a b c"), (None, "a b c"), ("und", "a b c"), ("en", None), ("en", ""), (None, None),
             ("en", "a b c"), ("en", "a b c"), ("de", "é 世界 é 世界\x0b é 世界"), ("", "x y x y"),
             ("en", "lo ng " * 3000), ("en", "w" * 40_000 + " b c " + "w" * 40_000 + " b c")]
    df = spark.createDataFrame(
        [(i, t, lang, 1, "p", 2, 3) for i, (lang, t) in enumerate(texts)],
        "doc_id long, text string, lang string, n int, phrase string, words int, part int")
    for threshold in (1, 2, 3):
        assert result(collocations(df, threshold=threshold, top=None)) == brute(texts, threshold)
    assert collocations(no_documents).collect() == []


def test_one_phrase_fills_the_table(spark):
    df = spark.range(3000, numPartitions=4).select(
        F.when(F.col("id") % 3 == 0, F.concat(F.lit("own "), F.col("id"), F.lit(" word"))).otherwise(
            F.lit("one hot phrase")).alias("text"), F.lit("en").alias("lang"))
    rows = [(r.lang, r.text) for r in df.collect()]
    assert result(collocations(df, threshold=50, top=None)) == brute(rows, 50)


def test_products_beyond_64_bits(spark):
    """The score's arithmetic, on counts as large as those of a corpus of 10**13 words."""
    a, n, left, right = 9_876_543_210_123, 98_765_432_101_234, 9_876_543_219_999, 9_976_543_210_777
    row = spark.createDataFrame([(a, n, left, right)], "a long, n long, l long, r long").selectExpr(
        "cast(a * 1000 as decimal(19, 0)) * cast(n as decimal(19, 0)) div "
        "(cast(l as decimal(19, 0)) * cast(r as decimal(19, 0))) as score").first()
    assert row.score == 1000 * a * n // (left * right)
