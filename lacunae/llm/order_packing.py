"""Packing in document order: cuts at document and sentence ends chosen by dynamic programming.

The documents, in order, are one stream of tokens. A sequence is a window of the stream of at most `capacity`
tokens, so a plan is a list of cuts. A window costs what it is padded with, a cut inside a document costs a penalty
(a smaller one at a sentence end than within an over-long sentence), and the plan of least total cost is

    best(i) = min over earlier places j within the capacity of best(j) + padding(i - j) + penalty(i)

Padding is capacity - (i - j), so the least best(j) + j of a sliding window decides: a queue with rising values
gives it in constant time. Windows whose length is a power of two are not padded; there are few such lengths, and
their starts are looked up.

1. Every task tokenises its documents and keeps, per possible cut, its place and the checksum of the ids before
   it. Ids are not stored: a piece's checksum follows from the two at its ends.
2. Those rows (about a twelfth of the text) are dealt by ranges of the order and planned block by block, in
   runs of a bounded number of places. Only the last window of a run may be short for want of text.
"""

from __future__ import annotations

import itertools
import math
import re
import zlib
from array import array
from collections import deque
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept, slices, stored

# Fixed value: the pre-tokens of the word-end vocabulary. None holds white space.
WORD_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
SENTENCE_END = re.compile(r"""[.!?…。！？]["'”’»)\]]*$""")
SENTENCE_BREAK = re.compile(r"""[.!?…。！？]["'”’»)\]]*(?=[ \n])|\n""")
WORD_AND_MARKS = re.compile(r"([^\W\d_]+)([.,;:!?]*)")
KNOWN = 1_500_000
UNIT = 1 << 20


# ---- tokens and places to cut ----

class Codes(dict):
    """Numbers of chunks in the order in which they were first met."""

    def __missing__(self, chunk: str) -> int:
        self[chunk] = code = len(self)
        self.new.append(chunk)
        return code


class Encoded(NamedTuple):
    """Ids of texts one after the other, their number per text, and the sentence ends: text and ids before it."""

    ids: np.ndarray
    tokens: np.ndarray
    text: np.ndarray
    end: np.ndarray


class SentenceEncoder:
    """Ids of texts, and how many of them stand before each sentence end.

    A sentence ends with a line, or after a chunk (what stands between spaces) with a closing mark. Where no token
    crosses white space, ids are looked up by chunk; any other tokenizer is given whole texts.
    """

    def __init__(self, path: str, by_chunk: bool | None = None):
        import json
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        parts = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or []
        holds = (
            [x["type"] for x in (spec.get("normalizer") or {}).get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]
            and [x["type"] for x in parts] == ["Split", "ByteLevel"]
            and parts[0]["pattern"] == {"Regex": WORD_SPLIT} and parts[0]["invert"] and parts[0]["behavior"] == "Removed"
            and not parts[1]["add_prefix_space"] and not parts[1].get("use_regex", True)
            and spec["model"].get("end_of_word_suffix") == "</w>" and not spec.get("truncation")
            and not any(t["lstrip"] or t["rstrip"] or " " in t["content"] or "\n" in t["content"]
                        for t in spec.get("added_tokens") or []))
        self.by_chunk = holds if by_chunk is None else by_chunk and holds
        self.most_known = KNOWN
        vocabulary = self.tokenizer.get_vocab()
        self.closes = np.zeros(max(vocabulary.values()) + 1, bool)  # ids at the end of a pre-token
        self.closes[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self._forget()

    def _forget(self) -> None:
        self.codes, self.cores = Codes(), {"": b""}
        self.codes.new = []
        self.body = np.empty(1 << 16, np.uint32)  # ids of all chunks
        self.first = np.zeros(1, np.int64)  # where each begins in it, and the end of the last
        self.ends = np.zeros(0, bool)

    def _encode(self, texts: list[str]) -> Iterator[bytes]:
        for i in range(0, len(texts), 500):
            for found in self.tokenizer.encode_batch_fast(texts[i:i + 500], add_special_tokens=False):
                yield array("I", found.ids).tobytes()

    def _learn_cores(self, words: list[str]) -> None:
        """Ids of words of letters, encoded in rows and cut at the ids that end a pre-token.

        A row in which some word is more than one pre-token is encoded word by word.
        """
        rows = [words[i:i + 200] for i in range(0, len(words), 200)]
        for row, ids in zip(rows, self._encode([" ".join(row) for row in rows]), strict=True):
            cuts = (4 * (np.flatnonzero(self.closes[np.frombuffer(ids, np.uint32)]) + 1)).tolist()
            if len(cuts) == len(row):
                self.cores.update(zip(row, [ids[a:b] for a, b in itertools.pairwise([0, *cuts])]))
            else:
                self.cores.update(zip(row, self._encode(row), strict=True))

    def _learn(self) -> None:
        """Ids of the chunks that are new: a word and its closing marks apart, all else as it is."""
        chunks, self.codes.new = self.codes.new, []
        split = [m.groups() if (m := WORD_AND_MARKS.fullmatch(c.lower() if c.isascii() else c)) else None for c in chunks]
        words = {m[0] for m in split if m}
        marks = {m[1] for m in split if m}
        self._learn_cores([x for x in words if x not in self.cores])
        new_marks = [x for x in marks if x not in self.cores]
        self.cores.update(zip(new_marks, self._encode(new_marks), strict=True))
        odd = self._encode([c for c, m in zip(chunks, split, strict=True) if not m])
        cores = self.cores
        found = [cores[m[0]] + cores[m[1]] if m else next(odd) for m in split]
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        start = self.first[-1]
        self.first = np.concatenate([self.first, start + np.cumsum(sizes)])
        while self.first[-1] > len(self.body):
            self.body = np.concatenate([self.body, np.empty_like(self.body)])
        self.body[start:self.first[-1]] = np.frombuffer(b"".join(found), np.uint32)
        ends = [c == "\n" or bool(SENTENCE_END.search(c)) for c in chunks]
        self.ends = np.concatenate([self.ends, np.array(ends, bool)])

    def __call__(self, texts: list[str]) -> Encoded:
        if not self.by_chunk:
            return self._whole(texts)
        if len(self.codes) > self.most_known:
            self._forget()
        parts: list[str] = []
        counts = []
        for t in texts:
            own = t.replace("\n", " \n ").split(" ")
            counts.append(len(own))
            parts += own
        codes = np.fromiter(map(self.codes.__getitem__, parts), np.int64, len(parts))
        if self.codes.new:
            self._learn()
        text = np.repeat(np.arange(len(texts)), counts)
        sizes = np.diff(self.first)[codes]
        after = np.cumsum(sizes)
        ids = self.body[np.repeat(self.first[codes] - (after - sizes), sizes) + np.arange(sizes.sum())]
        last = np.cumsum(counts) - 1
        bounds = np.concatenate([[0], after[last]]) if len(texts) else np.zeros(1, np.int64)
        flagged = np.flatnonzero(self.ends[codes])
        return Encoded(ids, np.diff(bounds), text[flagged], after[flagged] - bounds[text[flagged]])

    def _whole(self, texts: list[str]) -> Encoded:
        all_ids, tokens, of, ends = [np.empty(0, np.uint32)], [], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for number, text in enumerate(texts):
            found = self.tokenizer.encode_batch([text], add_special_tokens=False)[0]
            starts = np.array([a for a, _ in found.offsets], np.int64)
            breaks = [m.end() for m in SENTENCE_BREAK.finditer(text)]
            all_ids.append(np.array(found.ids, np.uint32))
            tokens.append(len(found.ids))
            ends.append(np.searchsorted(starts, breaks))
            of.append(np.full(len(breaks), number))
        return Encoded(np.concatenate(all_ids), np.array(tokens, np.int64), np.concatenate(of), np.concatenate(ends))


def places_of(found: Encoded, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, place, inside) of all possible cuts by text and place; the end of a text counts its end id."""
    n = found.tokens
    inner = (found.end > 0) & (found.end < n[found.text])
    key = np.concatenate([found.text[inner] << 32 | found.end[inner], np.arange(len(n)) << 32 | n + 1])
    key = np.unique(key)
    text, place = key >> 32, key & 0xFFFFFFFF
    before = np.concatenate([[0], place[:-1]]) * (np.concatenate([[-1], text[:-1]]) == text)
    more = (place - before - 1) // longest  # cuts within each sentence
    inside = np.zeros(len(key), np.int8)
    if more.any():
        at = np.repeat(np.arange(len(key)), more)
        number = np.arange(len(at)) - np.repeat(np.cumsum(more) - more, more) + 1
        extra = before[at] + number * longest
        ok = extra < n[text[at]]  # the end id is never alone
        extra = text[at][ok] << 32 | extra[ok]
        inside = np.concatenate([inside, np.ones(len(extra), np.int8)])
        key = np.concatenate([key, extra])
        order = np.argsort(key, kind="stable")
        key, inside = key[order], inside[order]
        text, place = key >> 32, key & 0xFFFFFFFF
    return text, place, inside


def cut_places(docs: DataFrame, tokenizer_path: str, end_id: int, longest: int, id_col: str, text_col: str,
               cached_chunks: int = KNOWN) -> DataFrame:
    """(id, doc_tokens, ends, inside, crcs): the places at which each document may be cut, its end included.

    `crcs` are the checksums of the ids before each place. A sentence of more than `longest` tokens can also be
    cut at every `longest`-th; `inside` is 1 there.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = kept(f"sentences {tokenizer_path}", lambda: SentenceEncoder(tokenizer_path))
        encode.most_known = cached_chunks
        for batch in slices(batches, text_col, 4 << 20):
            found = encode([t or "" for t in batch.column(1).to_pylist()])
            text, place, inside = places_of(found, longest)
            bounds = np.cumsum(found.tokens)
            ids = np.insert(found.ids, bounds, end_id).astype("<u4", copy=False)
            body = memoryview(ids).cast("B")
            start = np.concatenate([[0], bounds + np.arange(1, len(bounds) + 1)])
            stops = (4 * (start[text] + place)).tolist()
            last = place == found.tokens[text] + 1
            crc, before, crcs = 0, 0, []
            for stop, ends in zip(stops, last.tolist()):
                crc = zlib.crc32(body[before:stop], crc)
                crcs.append(crc)
                before = stop
                if ends:
                    crc = 0
            cuts = pa.array(np.concatenate([[0], np.flatnonzero(last) + 1]).astype(np.int32))
            lists = [pa.ListArray.from_arrays(cuts, pa.array(x)) for x in (
                place.astype(np.int32), inside, np.array(crcs, np.uint32).view(np.int32))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(found.tokens + 1), *lists],
                ["id", "doc_tokens", "ends", "inside", "crcs"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(
        run, f"id {kind}, doc_tokens long, ends array<int>, inside array<tinyint>, crcs array<int>")


# ---- plan ----

def best_cuts(places: np.ndarray, penalties: np.ndarray, capacity: int) -> list[int]:
    """Numbers of the places at which the cheapest windows end.

    `places` rise from 0 with steps of at most `capacity`; `penalties[i]` is the cost of a cut at place i. Of plans
    of one cost, one with the fewest windows is taken.
    """
    n = len(places)
    from_power: list[list[int]] = [[] for _ in range(n)]
    for k in range(capacity.bit_length()):
        at = np.searchsorted(places, places - (1 << k))
        hit = np.flatnonzero((places[at] == places - (1 << k)) & (1 << k <= capacity))
        for i, j in zip(hit.tolist(), at[hit].tolist()):
            from_power[i].append(j)
    where = places.tolist()
    fee = (np.asarray(penalties, np.int64) * UNIT + 1).tolist()
    best, came = [0] * n, [0] * n
    queue: deque[tuple[int, int, int]] = deque([(0, 0, 0)])  # (value, place, number), values rise
    for i in range(1, n):
        here = where[i]
        while queue[0][1] < here - capacity:
            queue.popleft()
        value, _, j = queue[0]
        value += (capacity - here) * UNIT
        for other in from_power[i]:
            if best[other] < value:
                value, j = best[other], other
        value += fee[i]
        best[i], came[i] = value, j
        value += here * UNIT
        while queue and queue[-1][0] >= value:
            queue.pop()
        queue.append((value, here, i))
    cuts = []
    i = n - 1
    while i:
        cuts.append(i)
        i = came[i]
    return cuts[::-1]


# ---- checksums ----

class Shift:
    """Checksum of ids followed by n zero bytes, without the zeros' share: crc(ab) = shift(crc(a), len(b)) ^ crc(b)."""

    POLYNOMIAL = 0xEDB88320  # fixed value of the public checksum

    def __init__(self):
        step = []
        for i in range(32):
            x = 1 << i
            for _ in range(8):
                x = x >> 1 ^ (self.POLYNOMIAL if x & 1 else 0)
            step.append(x)
        self.powers = [np.array(step, np.uint32)]

    def _apply(self, matrix: np.ndarray, x: np.ndarray) -> np.ndarray:
        out = np.zeros_like(x)
        for i in range(32):
            out ^= np.where(x >> np.uint32(i) & np.uint32(1), matrix[i], np.uint32(0))
        return out

    def __call__(self, crc: np.ndarray, n_bytes: np.ndarray) -> np.ndarray:
        crc = crc.copy()
        for k in range(int(n_bytes.max(initial=0)).bit_length()):
            if k == len(self.powers):
                self.powers.append(self._apply(self.powers[-1], self.powers[-1]))
            rows = np.flatnonzero(n_bytes >> k & 1)
            crc[rows] = self._apply(self.powers[k], crc[rows])
        return crc


# ---- documents ----

def _pieces(ids: pa.Array, tokens: np.ndarray, sizes: np.ndarray, ends: np.ndarray, inside: np.ndarray,
            crcs: np.ndarray, capacity: int, penalties: tuple[int, int], shift: Shift) -> tuple:
    """Pieces of a run of documents; `ends`, `inside` and `crcs` are theirs one after the other."""
    bounds = np.concatenate([[0], np.cumsum(tokens)])
    document = np.repeat(np.arange(len(tokens)), sizes)
    places = np.concatenate([[0], bounds[document] + ends])
    costs = np.where(inside == 1, penalties[1], penalties[0])
    costs[np.cumsum(sizes) - 1] = 0  # document ends
    cuts = np.array(best_cuts(places, np.concatenate([[0], costs]), capacity))
    windows = np.concatenate([[0], places[cuts]])
    edges = np.unique(np.concatenate([windows, bounds]))
    start, stop = edges[:-1], edges[1:]
    doc = np.searchsorted(bounds, start, side="right") - 1
    window = np.searchsorted(windows, start, side="right") - 1
    sums = np.concatenate([[0], crcs.view(np.uint32)]).astype(np.uint32)
    first, last = sums[np.searchsorted(places, start)], sums[np.searchsorted(places, stop)]
    first[start == bounds[doc]] = 0
    length = stop - start
    crc = last ^ shift(first, 4 * length)
    return (ids.take(pa.array(doc)), start - bounds[doc], length, crc.astype(np.int64), tokens[doc], window,
            start - windows[window])


def pack_in_order(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 2,
                  sentence_penalty: int = 32, word_penalty: int = 256, longest: int = 512,
                  block_tokens: int = 1 << 23, most_blocks: int = 20_000, run_places: int = 200_000,
                  id_col: str = "doc_id", text_col: str = "text", cached_chunks: int = KNOWN) -> DataFrame:
    """Tokenise whole documents and pack them by rising id; one row per piece.

    Columns: the id, start, length, ids_crc32, doc_tokens, sequence_id, offset. Every id lies in one piece, and
    pieces follow each other in a sequence without gaps, in the order of the documents. A cut within a document
    costs `sentence_penalty` tokens of padding, within a sentence of more than `longest` tokens `word_penalty`.

    * A null text counts as empty (the end id alone). Null ids come first and stay null. Rows that repeat an id or
      a whole document are packed each by itself, in the order of the table.
    * A very long text is cut like any other. The special strings of the vocabulary become their ids.
    * An empty table gives an empty result. Other columns are not read.
    * A block is a range of the order of about `block_tokens` tokens, within it a run has `run_places` places
      to cut, or one document: both end a window, which costs at most `capacity` tokens of padding each.
    """
    if not 1 <= longest <= capacity:
        raise ValueError("longest must be 1 to capacity")
    found = cut_places(docs, tokenizer_path, end_id, longest, id_col, text_col, cached_chunks)
    # The number in the table tells equal ids apart, also for the ranges.
    found = stored(found.withColumn("row", F.monotonically_increasing_id()), "places")
    total = found.agg(F.sum("doc_tokens")).first()[0] or 0
    blocks = max(1, min(most_blocks, math.ceil(total / block_tokens)))
    dealt = found.repartitionByRange(blocks, "id", "row").sortWithinPartitions("id", "row").drop("row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shift = Shift()
        number = TaskContext.get().partitionId() << 40
        waiting: list[pa.RecordBatch] = []
        places = 0

        def planned() -> Iterator[pa.RecordBatch]:
            nonlocal number
            rows = pa.Table.from_batches(waiting).combine_chunks()
            ids, tokens, ends, inside, crcs = (c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c
                                               for c in rows.columns)
            sizes = ends.value_lengths().to_numpy().astype(np.int64)
            columns = _pieces(ids, tokens.to_numpy(), sizes, *(c.flatten().to_numpy() for c in (ends, inside, crcs)),
                              capacity, (sentence_penalty, word_penalty), shift)
            body, start, length, crc, doc_tokens, window, offset = columns
            yield pa.RecordBatch.from_arrays(
                [body, *map(pa.array, (start, length, crc, doc_tokens, window + number, offset))],
                [id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])
            number += int(window[-1]) + 1

        for batch in batches:
            before = 0
            sizes = batch.column(2).value_lengths().to_numpy()
            for row, size in enumerate(sizes.tolist()):
                places += size
                if places >= run_places:
                    waiting.append(batch.slice(before, row + 1 - before))
                    yield from planned()
                    waiting.clear()
                    before, places = row + 1, 0
            if before < batch.num_rows:
                waiting.append(batch.slice(before))
        if waiting:
            yield from planned()

    kind = docs.schema[id_col].dataType.simpleString()
    return dealt.mapInArrow(run, f"`{id_col}` {kind}, start long, length long, ids_crc32 long, doc_tokens long, "
                                 "sequence_id long, offset long")
