import zlib

import numpy as np
import pytest

from pyspark.sql import functions as F

from lacunae.llm import toxicity
from lacunae.llm.toxicity import (
    Distance,
    features,
    is_held_out,
    labelled_sample,
    score_toxicity,
    train,
    windows,
)


def test_held_out_documents(spark):
    """Accuracy on labels that were never learnt."""
    from lacunae.llm.queries import op2_toxicity

    sf = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    out = op2_toxicity(spark, sf).collect()
    assert len(out) == spark.read.parquet(f"{sf}/documents.parquet").count()
    for r in out:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
    held = [(labels[r.doc_id], r.predicted) for r in out if r.held_out and r.doc_id in labels]
    toxic = [p for y, p in held if y == 1]
    clean = [p for y, p in held if y == 0]
    assert len(toxic) > 50 and np.mean(toxic) > 0.85 and np.mean(clean) < 0.01


def test_windows():
    assert windows("Ab  c\nd") == [b" ab", b" c", b" d"]
    assert windows(None) == windows("") == windows(" \n") == []
    assert b"".join(windows("x" * 1000)) == b" " + b"x" * 1000
    assert max(map(len, windows("x" * 1000))) <= 64


def test_toxic_dictionary_shortens_toxic_windows():
    rng = np.random.default_rng(0)
    plain = [" ".join("".join(rng.choice(list("aeioulnrst"), 6)) for _ in range(80)) for _ in range(300)]
    toxic = [" ".join(w + " gruffbast" * (i % 20 == 0) for i, w in enumerate(t.split())) for t in plain[:100]]
    model = train(toxic, plain[100:], 0.3)
    distance = Distance(model.ordinary, model.toxic)
    assert distance([b" gruffbast"])[0] > np.mean(distance(windows(plain[0])))
    rows = np.array([features(distance(windows(t))) for t in [toxic[99], plain[250], ""]])
    score = model.scores(rows)
    assert score[0] > 0.5 > max(score[1], score[2])


@pytest.mark.parametrize("labels,score", [([], 0.0), ([(1, 1)], 1.0), ([(1, 0), (6, 0)], 0.0), ([(1, None)], 0.0)])
def test_labels_of_one_kind(spark, odd_documents, labels, score):
    table = spark.createDataFrame(labels, "doc_id long, toxic int")
    out = score_toxicity(odd_documents, table).collect()
    assert len(out) == 12 and {r.score for r in out} == {score}


def test_odd_rows(spark, odd_documents, no_documents):
    table = spark.createDataFrame([(1, 1), (2, 0), (6, 0), (7, 1), (None, 1), (5, 0), (9, 1), (4, 0)],
                                  "doc_id long, toxic int")
    out = score_toxicity(odd_documents.withColumnRenamed("n", "score"), table)
    assert out.columns == [*(c for c in odd_documents.columns if c != "n"), "score", "predicted"]
    rows = out.collect()
    assert len(rows) == 12 and all(0 <= r.score <= 1 for r in rows)
    assert score_toxicity(no_documents, table).collect() == []


def test_a_very_long_first_document(spark, monkeypatch):
    """The first document of each class in hash order is longer than all text that is sampled."""
    monkeypatch.setattr(toxicity, "SAMPLE_BYTES", 1 << 17)
    ids = [r.id for r in spark.range(100).where(~is_held_out("id")).orderBy(F.xxhash64("id")).collect()]
    long = " ".join(f"long{i}" for i in range(10_000))
    rows = [(i, long if at < 2 else f"short {i}") for at, i in enumerate(ids)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, at % 2) for at, i in enumerate(ids)], "doc_id long, toxic int")
    toxic, ordinary, share = labelled_sample(docs, labels, 4000, "doc_id", "text", "toxic")
    assert len(toxic) == len(ids) // 2 and len(ordinary) == len(ids) - len(ids) // 2
    for texts in toxic, ordinary:
        words = texts[0].split()
        assert 500 < len(texts[0]) <= 1024 and set(words) <= set(long.split())
        assert int(words[0][4:]) < 10 and int(words[-1][4:]) > 9_980
