"""Benchmark decontamination with an FM-index over every shard of documents.

A shard is a slice of some MB of a task's documents. Its words become symbols: the number of the
word in the benchmark's vocabulary, or a gap. A window can only occur within a run of vocabulary
words at least as long as the shortest window, so only such runs enter the index; they are found in
all documents. The index is the Burrows-Wheeler transform of these symbols in a wavelet matrix with
ranks, and the positions of every eighth symbol. All windows are searched backward at once, their
occurrences are located by walking to sampled positions, and overlapping ones merge into spans.

The benchmark comes in blocks of about `block_words` words, so that what goes to all tasks has a
bound; documents are read once per block. Words are compared by 64-bit hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, stored
from .words import Rolling, Words, letters_and_digits

SAMPLE = 8


class WaveletMatrix:
    """Ranks of symbols in a sequence, level by level from the highest bit."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.bits = bits
        self.ones: list[np.ndarray] = []
        self.zeros: list[int] = []
        for level in range(bits - 1, -1, -1):
            bit = (symbols >> level) & 1
            ones = np.zeros(len(symbols) + 1, np.int32)
            np.cumsum(bit, out=ones[1:])
            self.ones.append(ones)
            self.zeros.append(len(symbols) - int(ones[-1]))
            symbols = np.concatenate([symbols[bit == 0], symbols[bit == 1]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each place."""
        low = np.zeros(len(at), np.int64)
        for level, (ones, zeros) in enumerate(zip(self.ones, self.zeros, strict=True)):
            bit = (symbol >> (self.bits - 1 - level)) & 1 == 1
            low = np.where(bit, zeros + ones[low], low - ones[low])
            at = np.where(bit, zeros + ones[at], at - ones[at])
        return at - low

    def symbol_rank(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each place, and how often it stands before it."""
        low = np.zeros(len(at), np.int64)
        symbol = np.zeros(len(at), np.int64)
        for ones, zeros in zip(self.ones, self.zeros, strict=True):
            bit = ones[at + 1] > ones[at]
            symbol = symbol << 1 | bit
            low = np.where(bit, zeros + ones[low], low - ones[low])
            at = np.where(bit, zeros + ones[at], at - ones[at])
        return symbol, at - low


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Suffix array by doubling; the text ends with its only smallest symbol."""
    n = len(text)
    _, rank = np.unique(text, return_inverse=True)
    width = 1
    while True:
        following = np.zeros(n, np.int64)
        following[:n - width] = rank[width:] + 1
        key = rank * (n + 1) + following
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
        if rank[order[-1]] == n - 1 or width >= n:
            return order
        width *= 2


class FMIndex:
    def __init__(self, text: np.ndarray, n_symbols: int):
        order = suffix_order(text)
        bwt = text[order - 1]
        self.smaller = np.concatenate(
            [[0], np.cumsum(np.bincount(text, minlength=n_symbols))]).astype(np.int64)
        self.tree = WaveletMatrix(bwt, max(1, int(n_symbols - 1).bit_length()))
        self.sampled = order % SAMPLE == 0
        self.sample_rank = np.concatenate([[0], np.cumsum(self.sampled)])
        self.samples = order[self.sampled]
        self.n = len(text)

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Range of suffixes that start with each pattern (right-aligned rows of symbols)."""
        low = np.zeros(len(patterns), np.int64)
        high = np.full(len(patterns), self.n, np.int64)
        for step in range(patterns.shape[1]):
            live = np.flatnonzero((lengths > step) & (low < high))
            if not len(live):
                break
            symbol = patterns[live, patterns.shape[1] - 1 - step]
            low[live] = self.smaller[symbol] + self.tree.rank(symbol, low[live])
            high[live] = self.smaller[symbol] + self.tree.rank(symbol, high[live])
        return low, high

    def locate(self, at: np.ndarray) -> np.ndarray:
        """Text positions of suffixes: walk back to a sampled one, count the steps."""
        out = np.empty(len(at), np.int64)
        todo, steps = np.arange(len(at)), 0
        while len(todo):
            known = self.sampled[at]
            out[todo[known]] = self.samples[self.sample_rank[at[known]]] + steps
            todo, at = todo[~known], at[~known]
            symbol, rank = self.tree.symbol_rank(at)
            at = self.smaller[symbol] + rank
            steps += 1
        return out


class Phrases:
    """Windows of a block of benchmark items: symbols, and the items of each window."""

    def __init__(self, items: list[str], texts: list[str], width: int):
        words = Words(pa.array(texts, pa.string()), letters_and_digits(), Rolling())
        self.vocabulary = np.unique(words.hashes)
        numbers = np.searchsorted(self.vocabulary, words.hashes) + 2
        found: dict[tuple[int, ...], set[str]] = {}
        for item, a, b in zip(items, words.first[:-1], words.first[1:], strict=True):
            for start in range(a, max(a + (b > a), b - width + 1)):
                found.setdefault(tuple(numbers[start:min(b, start + width)].tolist()), set()).add(item)
        self.lengths = np.array([len(w) for w in found], np.int64)
        self.patterns = np.zeros((len(found), width), np.int64)
        for row, window in enumerate(found):
            self.patterns[row, width - len(window):] = window
        self.items = [sorted(x) for x in found.values()]
        self.shortest = int(self.lengths.min()) if found else 0
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(self.vocabulary >> np.uint64(44)).astype(np.int64)] = True

    def symbols(self, hashes: np.ndarray) -> np.ndarray:
        """Number of each word, 0 for words that are in no item."""
        out = np.zeros(len(hashes), np.int64)
        near = np.flatnonzero(self.maybe[(hashes >> np.uint64(44)).astype(np.int64)])
        at = np.searchsorted(self.vocabulary, hashes[near])
        same = self.vocabulary[np.minimum(at, len(self.vocabulary) - 1)] == hashes[near]
        out[near[same]] = at[same] + 2
        return out


def occurrences(words: Words, phrases: Phrases) -> tuple[np.ndarray, np.ndarray]:
    """(first word, window) of every occurrence in a shard."""
    none = np.empty(0, np.int64), np.empty(0, np.int64)
    symbols = phrases.symbols(words.hashes)
    n = len(symbols)
    if not n:
        return none
    inside = symbols > 0
    breaks = np.zeros(n, bool)
    breaks[words.first[:-1][words.first[:-1] < n]] = True
    starts = np.flatnonzero(inside & (breaks | ~np.concatenate([[False], inside[:-1]])))
    ends = np.flatnonzero(inside & np.concatenate([breaks[1:] | ~inside[1:], [True]])) + 1
    kept = ends - starts >= phrases.shortest
    starts, ends = starts[kept], ends[kept]
    if not len(starts):
        return none
    # Runs one after the other, a gap (1) behind each, and the end (0).
    lengths = ends - starts + 1
    run_at = np.concatenate([[0], np.cumsum(lengths)])
    origin = np.arange(run_at[-1]) + np.repeat(starts - run_at[:-1], lengths)
    text = symbols[np.minimum(origin, n - 1)]
    text[run_at[1:] - 1] = 1
    index = FMIndex(np.concatenate([text, [0]]), len(phrases.vocabulary) + 2)
    low, high = index.search(phrases.patterns, phrases.lengths)
    count = np.maximum(high - low, 0)
    window = np.repeat(np.arange(len(count)), count)
    at = np.arange(len(window)) + np.repeat(low - (np.cumsum(count) - count), count)
    return origin[index.locate(at)], window


SCHEMA = "n_words long, word_spans array<struct<first:long,end:long,start_byte:long,end_byte:long>>, item_ids array<string>"
SPANS = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64()),
                            ("start_byte", pa.int64()), ("end_byte", pa.int64())]))


def lists(values: pa.Array, owners: np.ndarray, n: int) -> pa.ListArray:
    """One list per row from values ordered by owner."""
    return pa.ListArray.from_arrays(
        pa.array(np.searchsorted(owners, np.arange(n + 1)), pa.int32()), values)


def search_block(block, text_at: int, merge: bool):
    """Mark the occurrences of a block's windows; `merge` with those of earlier blocks in the rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases, rolling = block.value, Rolling()
        for batch in slices(batches, "_text", 4 << 20):
            words = Words(batch.column(text_at), letters_and_digits(), rolling)
            n, rows = len(words.starts), batch.num_rows
            if len(phrases.items):
                first, window = occurrences(words, phrases)
            else:
                first = window = np.empty(0, np.int64)
            step = np.zeros(n + 1, np.int64)
            np.add.at(step, first, 1)
            np.add.at(step, first + phrases.lengths[window], -1)
            hit = np.cumsum(step)[:n] > 0
            found = np.unique(np.stack([np.searchsorted(words.first, first, side="right") - 1, window]), axis=1)
            pairs = sorted({(d, i) for d, w in found.T.tolist() for i in phrases.items[w]})
            if merge:
                old = batch.column(batch.num_columns - 2)
                doc = np.repeat(np.arange(rows), old.value_lengths().to_numpy())
                old = old.flatten()
                step[:] = 0
                np.add.at(step, words.first[doc] + old.field("first").to_numpy(), 1)
                np.add.at(step, words.first[doc] + old.field("end").to_numpy(), -1)
                hit |= np.cumsum(step)[:n] > 0
                earlier = [(d, i) for d, x in enumerate(batch.column(batch.num_columns - 1).to_pylist()) for i in x]
                pairs = sorted({*pairs, *earlier})
            edge = np.zeros(n + 1, bool)
            edge[words.first] = True
            left = np.flatnonzero(hit & (edge[:n] | ~np.concatenate([[False], hit[:-1]])))
            right = np.flatnonzero(hit & (edge[1:] | ~np.concatenate([hit[1:], [False]])))
            doc = np.searchsorted(words.first, left, side="right") - 1
            spans = pa.StructArray.from_arrays(
                [pa.array(x) for x in (
                    left - words.first[doc], right + 1 - words.first[doc],
                    words.starts[left] - words.offsets[doc], words.ends[right] - words.offsets[doc])],
                fields=list(SPANS.value_type))
            owners = np.array([d for d, _ in pairs], np.int64)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:batch.num_columns - 3 * merge], pa.array(np.diff(words.first)),
                 lists(spans, doc, rows), lists(pa.array([i for _, i in pairs], pa.string()), owners, rows)],
                [*batch.schema.names[:batch.num_columns - 3 * merge], "n_words", "word_spans", "item_ids"])
    return run


def find_leaks(docs: DataFrame, benchmark: DataFrame, width: int = 10,
               block_words: int = 2_000_000, text_col: str = "text", item_col: str = "item_id",
               item_text_col: str = "text") -> DataFrame:
    """All rows and columns of `docs`, with `n_words`, `word_spans` and `item_ids`.

    `word_spans` are the merged spans of words inside an occurrence of a window of `width`
    consecutive item words (all words of a shorter item), as word and as byte positions;
    `item_ids` are the items with such windows, sorted as strings.

    * A null or empty text has no words. An item without words matches nothing; items with a null
      id are known as "null". Items that repeat count once per id.
    * Rows that repeat are searched each by itself. An empty table of documents gives no rows, an
      empty benchmark no spans.
    * Columns of `docs` are kept; they must not be called like the new ones or `_text`.
    """
    spark = docs.sparkSession
    items = benchmark.select(
        F.coalesce(F.col(item_col).cast("string"), F.lit("null")).alias("item"),
        F.coalesce(F.col(item_text_col), F.lit("")).alias("text"))
    words = items.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0
    blocks = max(1, -(-words // (6 * block_words)))
    out = docs.withColumn("_text", F.col(text_col))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema)
    for k in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == k).collect()
        block = spark.sparkContext.broadcast(
            Phrases([r.item for r in rows], [r.text for r in rows], width))
        if k:
            out = stored(out, "leaks")
        out = out.mapInArrow(search_block(block, len(docs.columns), k > 0), f"{fields}, {SCHEMA}")
    return out.drop("_text")


def leak_report(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts and digest of the result of `find_leaks`."""
    hit = F.aggregate("word_spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["first"])
    return found.select(
        id_col, "n_words", hit.alias("n_hit"), F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"))


def without_spans(text: F.Column, spans: F.Column) -> F.Column:
    """Text without the bytes of its spans; a space stays where words were taken out."""
    body = text.cast("binary")

    def step(state, span):
        kept = F.substring(body, (state["at"] + 1).cast("int"),
                           (span["start_byte"] - state["at"]).cast("int"))
        return F.struct(F.concat(state["out"], kept, F.lit(b" ")).alias("out"),
                        span["end_byte"].alias("at"))

    start = F.struct(F.lit(b"").alias("out"), F.lit(0).cast("long").alias("at"))
    return F.when(F.size(spans) == 0, text).otherwise(F.aggregate(
        spans, start, step, lambda s: F.concat(s["out"], F.substring(
            body, (s["at"] + 1).cast("int"), F.octet_length(body).cast("int"))).cast("string")))
