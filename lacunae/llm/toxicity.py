"""Toxic documents by compression distance under two trained zstandard dictionaries.

A text is cut into windows of a word each (long words into `WINDOW` bytes). A window is compressed
under a dictionary trained on ordinary text and under one trained on toxic text; the difference of the
lengths says which of them explains it better. A document's evidence is how far its largest
differences go and how many pass each threshold; a logistic regression turns that into a score.

Only whole documents are labelled, and most of a toxic one is ordinary. The toxic training text is
therefore made of the windows that are `contrast` times as common in toxic sample documents as in
ordinary ones and stand in `least_documents` of them. Half of the sample trains the dictionaries,
the other half the thresholds' weights.

The sample is bounded by `sample` toxic and twice as many ordinary documents and `SAMPLE_BYTES` of text. Of a
document longer than 1/64 of its class's text, words from places spread over it are taken, so that
no document crowds out the others.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices

WINDOW = 64
LEVEL = 6
PAD = b"\n" * 40  # zstandard finds no match that begins in a block's last bytes
THRESHOLDS = np.arange(1, 9)
TOP = 4
FLOOR = -12
SAMPLE_BYTES = 48 << 20
MAX_KNOWN = 200_000


def windows(text: str | None) -> list[bytes]:
    """Words with a space before them, in lower case; long ones in parts."""
    out = []
    for word in (text or "").lower().split():
        body = b" " + word.encode()
        if len(body) <= WINDOW:
            out.append(body)
        else:
            out.extend(body[i:i + WINDOW] for i in range(0, len(body), WINDOW))
    return out


def trained(samples: list[bytes], size: int):
    """Trained dictionary; from too little text, the text itself."""
    import zstandard

    try:
        return zstandard.train_dictionary(size, samples, k=24, d=6, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def grouped(parts: list[bytes], size: int = 96) -> list[bytes]:
    out, now = [], b""
    for part in parts:
        now += part
        if len(now) >= size:
            out.append(now)
            now = b""
    return [*out, now] if now else out


class Distance:
    """Ordinary minus toxic compressed length of windows."""

    def __init__(self, ordinary: bytes, toxic: bytes):
        import zstandard

        def compressor(body: bytes):
            book = zstandard.ZstdCompressionDict(body)
            book.precompute_compress(level=LEVEL)
            return zstandard.ZstdCompressor(
                dict_data=book, compression_params=zstandard.ZstdCompressionParameters.from_level(
                    LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False,
                    format=zstandard.FORMAT_ZSTD1_MAGICLESS)).compress

        self.ordinary, self.toxic = compressor(ordinary), compressor(toxic)
        self.known: dict[bytes, int] = {}

    def __call__(self, parts: list[bytes]) -> np.ndarray:
        known = self.known
        if len(known) > MAX_KNOWN:
            known.clear()
        for part in parts:
            if part not in known:
                padded = part + PAD
                known[part] = len(self.ordinary(padded)) - len(self.toxic(padded))
        return np.fromiter(map(known.__getitem__, parts), np.int64, len(parts))


def features(differences: np.ndarray) -> np.ndarray:
    """Largest differences, and how many windows pass each threshold."""
    top = np.full(TOP, FLOOR)
    best = np.sort(differences)[::-1][:TOP]
    top[:len(best)] = np.maximum(best, FLOOR)
    passed = np.array([(differences >= t).sum() for t in THRESHOLDS])
    share = passed / max(1, len(differences))
    return np.concatenate([top, np.log1p(passed), np.sqrt(share), [np.log1p(len(differences))]])


@dataclass
class Model:
    ordinary: bytes
    toxic: bytes
    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    base: float

    def scores(self, rows: np.ndarray) -> np.ndarray:
        if not len(self.weights):
            return np.full(len(rows), self.base)
        z = (rows - self.centre) / self.scale @ self.weights[:-1] + self.weights[-1]
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weighted logistic regression by Newton steps; the last coefficient is the constant."""
    x = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (weight * (y - p)) - penalty * w
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(curve, slope)
        w += step * min(1.0, 5 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    return w


def train(toxic: list[str], ordinary: list[str], toxic_share: float, contrast: float = 8.0,
          least_documents: int = 8, toxic_size: int = 2048, ordinary_size: int = 65536) -> Model:
    """Model from labelled texts; `toxic_share` is the share of toxic ones among all labelled."""
    nothing = Model(b"", b"", np.empty(0), np.empty(0), np.empty(0), 0.0)
    half_t, half_o = len(toxic) // 2, len(ordinary) // 2
    if not half_t or not half_o:
        return nothing if not toxic or ordinary else Model(b"", b"", np.empty(0), np.empty(0), np.empty(0), 1.0)
    same: dict[bytes, bytes] = {}  # one object per distinct window: the driver holds the words of a sample
    first = [[same.setdefault(w, w) for w in windows(t)] for t in toxic[:half_t]]
    plain = [[same.setdefault(w, w) for w in windows(t)] for t in ordinary[:half_o]]
    in_toxic = Counter(w for parts in first for w in set(parts))
    in_plain = Counter(w for parts in plain for w in set(parts))
    least = min(least_documents, half_t // 100 + 3)
    typical = {w for w, n in in_toxic.items()
               if n >= least and n / half_t > contrast * (in_plain[w] + 1) / (half_o + 1)}
    chosen = [w for parts in first for w in parts if w in typical]
    if not chosen:
        return Model(b"", b"", np.empty(0), np.empty(0), np.empty(0), toxic_share)
    # Windows in a mixed order, so that no document fills a sample.
    chosen = [chosen[i] for i in np.random.default_rng(0).permutation(len(chosen))]
    model = Model(trained(grouped([w for parts in plain for w in parts]), ordinary_size),
                  trained(grouped(chosen), toxic_size), np.empty(0), np.empty(0), np.empty(0), toxic_share)
    distance = Distance(model.ordinary, model.toxic)
    rest = [*toxic[half_t:], *ordinary[half_o:]]
    rows = np.array([features(distance(windows(t))) for t in rest])
    y = np.arange(len(rest)) < len(toxic) - half_t
    weight = np.where(y, toxic_share / y.sum(), (1 - toxic_share) / (~y).sum()) * len(rest)
    model.centre, model.scale = rows.mean(0), rows.std(0) + 1e-9
    model.weights = logistic((rows - model.centre) / model.scale, y.astype(float), weight)
    return model


def is_held_out(id_col: str) -> Column:
    """A fifth of all ids, whose labels are never learnt."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0


def spread(text: Column, most: int) -> Column:
    """The text; of one with more than `most` characters, the words at 16 places from its start to its end."""
    part = most // 16 - 1
    pieces = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.regexp_replace(F.substring(
        text, (i * ((F.length(text) - part) / 15)).cast("int") + 1, F.lit(part)), r"^\S+\s|\s\S+$", ""))
    return F.when(F.length(text) > most, F.array_join(pieces, " ")).otherwise(text)


def labelled_sample(docs: DataFrame, labels: DataFrame, sample: int, id_col: str, text_col: str,
                    label_col: str) -> tuple[list[str], list[str], float]:
    """Texts of the first labelled documents in hash order, toxic and ordinary, and the toxic share.

    Reading ends at the first text that does not fit; by then a class has 63/64 of its text, in 64 documents or more.
    """
    room = SAMPLE_BYTES // 2
    marked = labels.where(~is_held_out(id_col)).groupBy(F.col(id_col).alias("_id")).agg(
        F.max(label_col).alias("_label")).where("_label in (0, 1)")
    counts = {r["_label"]: r["count"] for r in marked.groupBy("_label").count().collect()}
    total = sum(counts.values())
    found: list[list[str]] = []
    for label, limit in ((1, sample), (0, 2 * sample)):
        order = F.xxhash64(F.col("_id"))
        ids = marked.where(F.col("_label") == label).orderBy(order, "_id").limit(limit)  # bounded
        rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).where(
            "_text is not null").join(F.broadcast(ids), "_id").select(
                order.alias("_order"), "_id", spread(F.col("_text"), room // 64).alias("_text"))
        texts, size = [], 0
        for row in rows.orderBy("_order", "_id", "_text").toLocalIterator():
            size += len(row["_text"])
            if size > room:
                break
            texts.append(row["_text"])
        found.append(list(dict.fromkeys(texts)))
    return found[0], found[1], counts.get(1, 0) / total if total else 0.0


def score_toxicity(docs: DataFrame, labels: DataFrame, sample: int = 4000, id_col: str = "doc_id",
                   text_col: str = "text", label_col: str = "toxic", **options) -> DataFrame:
    """All rows and columns of `docs`, with `score` (0 to 1) and `predicted` (score >= 0.5).

    Labels are learnt from rows of `labels` that are not held out (`is_held_out`); the score uses
    the text alone.

    * A null or empty text has no windows and scores like the shortest ordinary one.
    * Labels other than 0 and 1 and null ids teach nothing; an id with two labels counts as toxic.
      Without toxic labels all scores are 0, without ordinary ones 1, and without any contrast between
      the classes the share of toxic labels.
    * Rows that repeat are scored each by itself. An empty table gives an empty result.
    * Columns of `docs` are kept; `score` and `predicted` are replaced.
    """
    toxic, ordinary, share = labelled_sample(docs, labels, sample, id_col, text_col, label_col)
    model = docs.sparkSession.sparkContext.broadcast(train(toxic, ordinary, share, **options))
    kept = [c for c in docs.columns if c not in ("score", "predicted")]
    at = kept.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = model.value
        distance = Distance(now.ordinary, now.toxic) if len(now.weights) else None
        for batch in slices(batches, text_col, 4 << 20):
            if distance:
                rows = np.array([features(distance(windows(t))) for t in batch.column(at).to_pylist()])
            else:
                rows = np.empty((batch.num_rows, 0))
            scores = now.scores(rows)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))],
                [*batch.schema.names, "score", "predicted"])

    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept)
    return docs.select(*kept).mapInArrow(run, f"{fields}, score double, predicted int")
