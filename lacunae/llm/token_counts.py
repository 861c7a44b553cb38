"""Token counts from distinct pre-tokens, without token ids per document.

A pre-token is a maximal run of spaces with the run of other characters after it. No piece of the
vocabulary holds a space after another character (checked when the model is loaded), so merges never
cross pre-tokens and the counts of a text's pre-tokens add up to the count of the text.

1. Every task lists the pre-tokens that make up at least `heavy_share` of its own; the
   `heavy_limit` most frequent of them are counted once and go to all tasks (a bound of
   `heavy_limit` strings of at most `HEAVY_BYTES` bytes).
2. All others leave the documents as (pre-token, document, frequency), are dealt and sorted by
   pre-token, and meet their count there: each distinct one is counted once, where its run begins.
   A pre-token that is not heavy has at most `heavy_share` of all rows, so no task is hot.
3. Products are summed per document.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shuffle_tasks, slices

HEAVY_BYTES = 64
SPACES = "[ ▁]"
BOUNDARY = re.compile(f"(?<=[^ ▁]){SPACES}")


def load_model(path: str):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    for i in range(model.vocab_size()):
        if "▁" in model.id_to_piece(i).lstrip("▁"):
            raise ValueError("a piece crosses pre-tokens; counts would not add up")
    return model


def pre_tokens(text: str) -> Counter:
    """Frequencies of a text's pre-tokens, each without the first of its leading spaces.

    The library puts one space before every text it is given, so it is given a pre-token
    without its first. Only a trailing single space is an empty pre-token: one piece.
    """
    return Counter(BOUNDARY.split(text)) if text else Counter()


def pieces_of(model, units: list[str]) -> list[int]:
    """Counts of pre-tokens; the empty one is a lone space."""
    return [len(ids) if unit else 1
            for unit, ids in zip(units, model.encode(units, num_threads=1), strict=True)]


def frequent(text_col: str, share: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        limit, total, lost = int(2 / share), 0, 0
        for batch in slices(batches, text_col):
            for text in batch.column(0).to_pylist():
                if text:
                    units = BOUNDARY.split(text)
                    total += len(units)
                    seen.update(units)
            while len(seen) > 2 * limit:  # Misra-Gries: what stays has lost the same count
                cut = sorted(seen.values())[-limit]
                lost += cut
                seen = Counter({k: v - cut for k, v in seen.items() if v > cut})
        least = max(1, int(share * total) - lost)
        kept = [(k, v) for k, v in seen.items()
                if v >= least and len(k.encode()) <= HEAVY_BYTES]
        yield pa.RecordBatch.from_pydict({
            "unit": pa.array([k for k, _ in kept], pa.string()),
            "n": pa.array([v for _, v in kept], pa.int64())})
    return run


def spread_units(id_col: str, text_col: str, heavy):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = heavy.value
        row = TaskContext.get().partitionId() << 40
        for batch in slices(batches, text_col, 4 << 20):
            rows, ids, sizes, tokens, units, counts = [], [], [], [], [], []
            for doc, text in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                total, rare = 0, []
                for unit, n in pre_tokens(text or "").items():
                    pieces = known.get(unit)
                    if pieces is None:
                        rare.append((unit, n))
                    else:
                        total += pieces * n
                rows.append(row)
                ids.append(doc.as_py())
                sizes.append(len((text or "").encode()))
                tokens.append(total)
                units.append(None)
                counts.append(None)
                for unit, n in rare:
                    rows.append(row)
                    ids.append(None)
                    sizes.append(None)
                    tokens.append(None)
                    units.append(unit)
                    counts.append(n)
                row += 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows, pa.int64()), pa.array(ids, batch.schema.field(0).type),
                 pa.array(sizes, pa.int64()), pa.array(tokens, pa.int64()),
                 pa.array(units, pa.string()), pa.array(counts, pa.int64())],
                ["row", id_col, "n_bytes", "n_tokens", "unit", "n"])
    return run


def counted(path: str, id_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load_model(path)
        last, last_pieces = None, 0
        for batch in batches:
            units, n = batch.column(4), batch.column(5)
            distinct = [u for u in units.unique().to_pylist() if u is not None and u != last]
            pieces = dict(zip(distinct, pieces_of(model, distinct), strict=True))
            if last is not None:
                pieces[last] = last_pieces
            tokens = [t if u is None else pieces[u] * k for t, u, k in zip(
                batch.column(3).to_pylist(), units.to_pylist(), n.to_pylist(), strict=True)]
            if distinct:
                last, last_pieces = distinct[-1], pieces[distinct[-1]]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array(tokens, pa.int64())],
                ["row", id_col, "n_bytes", "n_tokens"])
    return run


def count_tokens(docs: DataFrame, model_path: str, limit: int = 4096, id_col: str = "doc_id",
                 text_col: str = "text", heavy_share: float = 2e-6,
                 heavy_limit: int = 1 << 18) -> DataFrame:
    """Bytes and tokens of every row's whole text.

    `model_path` is a sentencepiece model that the executors can read.

    * A null text counts as empty: 0 bytes, 0 tokens. A null id stays null.
    * Every row counts by itself, also when an id or a text repeats.
    * An empty table gives an empty result. Other columns are not read.
    """
    spark = docs.sparkSession
    texts = docs.select(id_col, text_col)
    heads = texts.select(text_col).mapInArrow(frequent(text_col, heavy_share), "unit string, n long")
    heads = heads.groupBy("unit").agg(F.sum("n").alias("n"))
    units = [r.unit for r in heads.orderBy(F.desc("n"), "unit").limit(heavy_limit).collect()]
    heavy = spark.sparkContext.broadcast(
        dict(zip(units, pieces_of(load_model(model_path), units), strict=True)))

    kind = docs.schema[id_col].dataType.simpleString()
    rows = texts.mapInArrow(
        spread_units(id_col, text_col, heavy),
        f"row long, `{id_col}` {kind}, n_bytes long, n_tokens long, unit string, n long")
    # A document's own row has no pre-token; its number spreads such rows.
    by_unit = rows.repartition(shuffle_tasks(spark), F.coalesce("unit", F.col("row").cast("string")))
    sums = by_unit.sortWithinPartitions("unit").mapInArrow(
        counted(model_path, id_col), f"row long, `{id_col}` {kind}, n_bytes long, n_tokens long")
    per_row = sums.groupBy("row").agg(
        F.max(id_col).alias(id_col), F.max("n_bytes").alias("n_bytes"),
        F.sum("n_tokens").alias("n_tokens"))
    return per_row.select(id_col, "n_bytes", "n_tokens",
                          (F.col("n_tokens") > limit).alias("over_limit"))
