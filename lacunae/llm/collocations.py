"""Collocations: frequent phrases whose words meet more often than their parts' counts suggest.

Finding all phrases with a count of at least `threshold` without counting every phrase:

1. Phrases are dealt by hash. A partition of total mass m gets a Misra-Gries summary of more than m / threshold
   counters, so its error stays below the threshold and every frequent phrase survives. Tasks send sums per
   partition, the partition merges them. First come single words and pairs; longer phrases take part only where
   all their pairs have survived.
2. Survivors are marked in a bit map of a fixed size, which goes to all tasks; a fuller map lets more pass.
3. A second pass counts what passes exactly, by its text, and counts below the threshold go.

Sub-phrases of a frequent phrase are frequent, so the exact counts hold all that the scores need.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, shuffle_tasks, slices, stored
from .words import Rolling, U, Words, mixed

PIECE_ENDS = b".,;:!?\n\x0b\x0c\r"
BLANKS = b" \t"
MAP_BITS = 1 << 26
SLICE_BYTES = 2 << 20
SENT_KEYS = 1_000_000
SENT_PHRASES = 200_000
FEW_LANGUAGES = 10_000


def _bytes_in(marks: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(marks)] = True
    return out


# ---- summaries ----

def summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, rising, with the sums of their counts."""
    keys, counts = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    if not len(keys):
        return keys, counts
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(counts, first)


class MisraGries:
    """Counts with at most `capacity` keys; each is too low by `error` at most, which is mass / (capacity + 1) at most."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.keys, self.counts = np.empty(0, np.uint32), np.empty(0, np.int64)
        self.error = 0
        self.waiting: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.waiting.append((keys, counts))
        self.size += len(keys)
        if self.size > max(self.capacity, 1 << 18):
            self.settle()

    def merge(self, other: MisraGries) -> None:
        other.settle()
        self.error += other.error
        self.add(other.keys, other.counts)

    def settle(self) -> None:
        """Sum what waits; if there are too many keys, take the largest count that loses its place off all."""
        if not self.waiting:
            return
        self.keys, self.counts = summed([(self.keys, self.counts), *self.waiting])
        self.waiting.clear()
        self.size = 0
        if len(self.keys) > self.capacity:
            at = len(self.keys) - self.capacity - 1
            cut = np.partition(self.counts, at)[at]
            self.counts = self.counts - cut
            self.error += int(cut)
            stay = self.counts > 0
            self.keys, self.counts = self.keys[stay], self.counts[stay]

    def at_least(self, threshold: int) -> np.ndarray:
        """All keys that may have that count; none that has it is missing while `error` is below it."""
        self.settle()
        return self.keys[self.counts + self.error >= threshold]


class Places:
    """Partition, 32-bit fingerprint and bit of a 64-bit phrase hash."""

    def __init__(self, parts: int):
        self.parts = parts
        self.bits = max(64, MAP_BITS // parts // 8 * 8)  # of the map, per partition

    def part(self, keys: np.ndarray) -> np.ndarray:
        return (keys >> U(32)) * U(self.parts) >> U(32)

    def bit(self, part: np.ndarray, prints: np.ndarray) -> np.ndarray:
        return part.astype(np.uint64) * U(self.bits) + (prints.astype(np.uint64) * U(self.bits) >> U(32))

    def passed(self, bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
        at = self.bit(self.part(keys), keys & U(0xFFFFFFFF))
        return bitmap[at >> U(3)] >> (U(7) - (at & U(7))).astype(np.uint8) & np.uint8(1) == 1


# ---- phrases of a batch ----

def language_key(lang: str) -> int:
    return int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little")


class Phrases:
    """Hashes of all phrases of a batch: that of `n` words from word i on, and whether they stand in one piece."""

    IS_WORD = ~_bytes_in(PIECE_ENDS + BLANKS)
    ENDS_PIECE = _bytes_in(PIECE_ENDS)

    def __init__(self, texts: pa.Array, langs: list[str], rolling: Rolling):
        self.langs = langs
        self.words = w = Words(texts, self.IS_WORD, rolling)
        n = len(w.starts)
        self.document = np.repeat(np.arange(len(langs)), np.diff(w.first))
        seeds = {x: language_key(x) for x in set(langs)}
        seed = np.array([seeds[x] for x in langs], np.uint64)
        self.single = mixed(w.hashes ^ seed[self.document]) if n else w.hashes
        before = np.cumsum(self.ENDS_PIECE[w.data], dtype=np.int32)
        self.joined = np.zeros(n, bool)  # with the next word
        if n:
            self.joined[:-1] = (before[w.starts[1:]] == before[w.ends[:-1] - 1]) & (
                self.document[1:] == self.document[:-1])

    def upto(self, longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(n, hashes, in one piece) for n = 1 to `longest`; entry i begins at word i."""
        keys, whole = self.single, np.ones(len(self.single), bool)
        for n in range(1, longest + 1):
            if n > 1:
                keys = mixed(keys[:-1] * U(0x9E3779B97F4A7C15) + self.single[n - 1:])
                whole = whole[:-1] & self.joined[n - 2:len(self.joined) - 1]
            yield n, keys, whole

    def frequent(self, longest: int, places: Places, maps: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(n, hashes, may be frequent) as far as the maps of the rounds so far tell."""
        pairs = None
        for n, keys, whole in self.upto(longest):
            if n > 2:
                # The pairs from word i to i + n - 2 have all survived.
                inner = inner[:-1] & pairs[n - 2:n - 2 + len(inner) - 1]
                whole = whole & inner
            if n <= 2 and maps:
                whole = _narrowed(whole, keys, places, maps[0])
            elif n > 2 and len(maps) > 1:
                whole = _narrowed(whole, keys, places, maps[1])
            if n == 2:
                pairs = inner = whole
            yield n, keys, whole


class PhraseCounts:
    """Counts of the phrases that a task has met, with their texts; sent by partition of their hash."""

    def __init__(self, places: Places):
        self.places = places
        self._empty()

    def _empty(self) -> None:
        self.number: dict[int, int] = {}
        self.keys: list[int] = []
        self.rows: list[tuple[str, bytes, int]] = []
        self.counts = np.zeros(0, np.int64)

    def _count(self, keys: np.ndarray, times: np.ndarray) -> np.ndarray:
        """Add to the counts of known keys; the numbers of the others, which get the next places."""
        at = np.fromiter(map(self.number.get, keys.tolist(), itertools.repeat(-1)), np.int64, len(keys))
        new = np.flatnonzero(at < 0)
        at[new] = len(self.keys) + np.arange(len(new))
        fresh = keys[new].tolist()
        self.number.update(zip(fresh, at[new].tolist()))
        self.keys += fresh
        self.counts = np.concatenate([self.counts, np.zeros(len(new), np.int64)])
        self.counts[at] += times
        return new

    def add(self, phrases: Phrases, longest: int, maps: list[np.ndarray]) -> None:
        w = phrases.words
        body = w.data.tobytes()
        # Phrases whose words are one space apart are cut out as they are.
        near = np.zeros(len(w.starts), bool)
        if len(near):
            near[:-1] = (w.starts[1:] - w.ends[:-1] == 1) & (w.data[w.ends[:-1]] == 0x20)
        gaps = np.concatenate([[0], np.cumsum(~near)])
        for n, keys, whole in phrases.frequent(longest, self.places, maps):
            rows = np.flatnonzero(whole)
            found, first, times = np.unique(keys[rows], return_index=True, return_counts=True)
            at = rows[first[self._count(found, times)]]
            plain = gaps[at + n - 1] == gaps[at]
            for i, d, a, b, as_is in zip(at.tolist(), phrases.document[at].tolist(), w.starts[at].tolist(),
                                         w.ends[at + n - 1].tolist(), plain.tolist()):
                text = body[a:b] if as_is else b" ".join(
                    body[s:e] for s, e in zip(w.starts[i:i + n].tolist(), w.ends[i:i + n].tolist()))
                self.rows.append((phrases.langs[d], text, n))
        total: dict[str, int] = {}
        for lang, n_words in zip(phrases.langs, np.diff(w.first).tolist()):
            total[lang] = total.get(lang, 0) + n_words
        langs = list(total)
        keys = np.array([language_key(x) for x in langs], np.uint64)
        for i in self._count(keys, np.array(list(total.values()), np.int64)).tolist():
            self.rows.append((langs[i], b"", 0))

    def sent(self) -> pa.RecordBatch:
        """A row per partition; the table is empty after that."""
        keys = np.array(self.keys, np.uint64)
        order = np.argsort(keys)
        part = self.places.part(keys[order])
        first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        cuts = pa.array(np.append(first, len(part)).astype(np.int32))
        rows = [self.rows[i] for i in order.tolist()]
        columns = (pa.array([r[0] for r in rows], pa.string()),
                   pa.array([r[1] for r in rows], pa.binary()).cast(pa.string()),
                   pa.array([r[2] for r in rows], pa.int32()), pa.array(self.counts[order]))
        self._empty()
        return pa.RecordBatch.from_arrays(
            [pa.array(part[first].astype(np.int32)), *[pa.ListArray.from_arrays(cuts, c) for c in columns]],
            ["part", "langs", "phrases", "words", "f"])


def _narrowed(whole: np.ndarray, keys: np.ndarray, places: Places, bitmap: np.ndarray) -> np.ndarray:
    rows = np.flatnonzero(whole)
    out = np.zeros(len(whole), bool)
    out[rows[places.passed(bitmap, keys[rows])]] = True
    return out


# ---- passes ----

def _read(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"),
                       F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def summarise(texts: DataFrame, sizes: range, threshold: int, places: Places, maps: list[Broadcast]) -> np.ndarray:
    """Bit map of all phrases of `sizes` words that may be frequent."""
    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, rolling = [m.value for m in maps], Rolling()
        waiting: list[tuple[np.ndarray, np.ndarray]] = []

        def dealt() -> pa.RecordBatch:
            found, counts = summed(waiting)
            part = places.part(found)
            first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
            rows = list(itertools.pairwise([*first.tolist(), len(found)]))
            prints, counts = (found & U(0xFFFFFFFF)).astype(np.uint32), counts.astype(np.uint32)
            return pa.RecordBatch.from_arrays(
                [pa.array([int(part[a]) for a, _ in rows], pa.int32()),
                 pa.array([int(counts[a:b].sum(dtype=np.int64)) for a, b in rows], pa.int64()),
                 pa.array([prints[a:b].tobytes() for a, b in rows], pa.binary()),
                 pa.array([counts[a:b].tobytes() for a, b in rows], pa.binary())],
                ["part", "mass", "prints", "counts"])

        for batch in slices(batches, "text", SLICE_BYTES):
            phrases = Phrases(batch.column(1), batch.column(0).to_pylist(), rolling)
            keys = [k[whole] for n, k, whole in phrases.frequent(sizes[-1], places, known) if n in sizes]
            waiting.append(np.unique(np.concatenate(keys), return_counts=True))
            if sum(len(k) for k, _ in waiting) > SENT_KEYS:
                yield dealt()
                waiting.clear()
        if any(len(k) for k, _ in waiting):
            yield dealt()

    sent = stored(texts.mapInArrow(sums, "part int, mass long, prints binary, counts binary"), "phrases")
    masses = {r["part"]: r["mass"] for r in sent.groupBy("part").agg(F.sum("mass").alias("mass")).collect()}

    def survivors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Partitions come one after the other."""
        now, summary = None, None

        def marked() -> pa.RecordBatch:
            bits = np.zeros(places.bits, np.uint8)
            prints = summary.at_least(threshold)
            bits[places.bit(np.zeros(len(prints)), prints)] = 1
            return pa.RecordBatch.from_arrays(
                [pa.array([now], pa.int32()), pa.array([np.packbits(bits).tobytes()], pa.binary())], ["part", "bits"])

        for batch in batches:
            for part, prints, counts in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if part != now:
                    if summary:
                        yield marked()
                    now, summary = part, MisraGries(masses[part] // threshold + 1)
                summary.add(np.frombuffer(prints, np.uint32), np.frombuffer(counts, np.uint32).astype(np.int64))
        if summary:
            yield marked()

    dealt = sent.select("part", "prints", "counts").repartition(places.parts, "part").sortWithinPartitions("part")
    bitmap = np.zeros(places.parts * places.bits // 8, np.uint8)
    each = places.bits // 8
    for row in dealt.mapInArrow(survivors, "part int, bits binary").collect():  # the map, in parts
        bitmap[row["part"] * each:(row["part"] + 1) * each] = np.frombuffer(row["bits"], np.uint8)
    discard(sent)
    return bitmap


def frequent_phrases(docs: DataFrame, longest: int = 5, threshold: int = 100, text_col: str = "text",
                     lang_col: str = "lang") -> DataFrame:
    """(lang, phrase, words, f): all phrases of 1 to `longest` words with f >= threshold, and how often they occur.

    The row of no words has all word occurrences of the language. Counts are exact.
    """
    spark = docs.sparkSession
    texts = _read(docs, text_col, lang_col)
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    places = Places(max(shuffle_tasks(spark), size >> 28))
    maps: list[Broadcast] = []
    for sizes in (range(1, min(longest, 2) + 1), range(3, longest + 1)):
        if sizes:
            maps.append(spark.sparkContext.broadcast(summarise(texts, sizes, threshold, places, maps)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, rolling = [m.value for m in maps], Rolling()
        table = PhraseCounts(places)
        for batch in slices(batches, "text", SLICE_BYTES):
            table.add(Phrases(batch.column(1), batch.column(0).to_pylist(), rolling), longest, known)
            if len(table.number) > SENT_PHRASES:
                yield table.sent()
        if table.number:
            yield table.sent()

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Partitions come one after the other; each holds no more phrases than have survived in it."""
        now, total = None, {}

        def frequent() -> pa.RecordBatch:
            rows = [(*k, f) for k, f in total.items() if f >= threshold or not k[2]]
            return pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(
                    (pa.string(), pa.string(), pa.int32(), pa.int64()))], ["lang", "phrase", "words", "f"])

        for batch in batches:
            for part, *columns in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if part != now:
                    if total:
                        yield frequent()
                    now, total = part, {}
                for lang, phrase, words, f in zip(*columns, strict=True):
                    key = lang, phrase, words
                    total[key] = total.get(key, 0) + f
        if total:
            yield frequent()

    sent = texts.mapInArrow(count, "part int, langs array<string>, phrases array<string>, words array<int>, f array<long>")
    return sent.repartition(places.parts, "part").sortWithinPartitions("part").mapInArrow(
        add_up, "lang string, phrase string, words int, f long")


# ---- scores ----

def _words(first: Column, number: Column) -> Column:
    return F.array_join(F.slice(F.split("phrase", " "), first, number), " ")


def collocations(docs: DataFrame, longest: int = 5, threshold: int = 100, top: int | None = 2000,
                 cover_percent: int = 100, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Phrases of 2 to `longest` words by their score: lang, rank, phrase, a, l, r, n, score.

    a, l and r are the counts of a phrase and of the two parts of its weakest cut, n all words of the language; the
    score is floor(1000 * a * n / (l * r)), in decimals of 38 digits. A phrase inside a longer one that has
    `cover_percent` of its count is left out. `top` is the number of ranks that a language shows (None: all).

    * A to Z are lower-cased. Texts are cut at `.,;:!?` and line ends, words at spaces and tabs; phrases don't cross
      cuts or documents. Null texts are empty. A null language is `und`.
    * Rows that repeat count each. Ties in score go by count, then by the bytes of the phrase.
    * Very long texts and words are treated like all others. An empty table gives an empty result.
    * Other columns are not read. The table is read four times: pass a stored one.
    * Phrases are told apart by their text; within a task, by a 64-bit hash.
    """
    counts = stored(frequent_phrases(docs, longest, threshold, text_col, lang_col), "counts")
    totals = counts.where("words = 0").select("lang", F.col("f").alias("n"))
    if totals.count() <= FEW_LANGUAGES:
        totals = F.broadcast(totals)
    known = counts.where("words > 0")
    phrases = known.where("words > 1").select("lang", "phrase", "words", F.col("f").alias("a"))

    size = F.col("words") - F.col("k")
    cuts = phrases.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1))).withColumns({
        "left": _words(F.lit(1), F.col("k")), "right": _words(F.col("k") + 1, size)})
    left = known.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l"))
    right = known.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r"))
    cuts = cuts.join(left, ["lang", "left"]).join(right, ["lang", "right"]).join(totals, "lang")
    whole = "decimal(19, 0)"
    score = F.expr(f"cast(a * 1000 as {whole}) * cast(n as {whole}) div (cast(l as {whole}) * cast(r as {whole}))")
    weakest = cuts.groupBy("lang", "phrase", "words", "a", "n").agg(
        F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))

    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.col("words") - 1), lambda m: F.transform(
        F.sequence(F.lit(1), F.col("words") - m + 1), lambda s: _words(s, m))))
    covers = phrases.where("words > 2").select("lang", F.explode(inner).alias("phrase"), "a").groupBy(
        "lang", "phrase").agg(F.max("a").alias("cover"))
    left_in = weakest.join(covers, ["lang", "phrase"], "left").where(
        F.coalesce(F.col("cover") * 100 < F.col("a") * cover_percent, F.lit(True)))
    out = left_in.select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = out.withColumn("rank", F.row_number().over(order).cast("long"))
    if top is not None:
        ranked = ranked.where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
