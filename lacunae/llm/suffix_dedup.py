"""Exact removal of repeated byte strings with suffix arrays per shard.

Strings of `length` bytes that are equal have the same smallest hashed `gram`-byte piece, so a text
is cut into segments of consecutive strings that share it, and segments with one such piece meet in
one shard. Only pieces that occur twice are followed up.

1. Tasks list their segments as (piece hash, content hash, place). Of equal segments in a batch only
   the first goes on; all strings of the others start earlier elsewhere.
2. By piece: a single segment holds nothing repeated; of equal segments the first stays, the others
   are removed whole. What is left are different segments around one piece.
3. Their bytes are fetched. A shard concatenates them, builds the suffix array by induced sorting and
   common prefixes in text order; neighbours that share `length` bytes are equal strings, and all
   but the earliest are removed. A piece with more than `hot_segments` different segments would not
   fit a task: its strings are dealt out one by one, by their hashes, instead.
4. Removed ranges are merged per document.

Pieces and contents are compared by 64-bit hashes each, both of which must agree.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shuffle_tasks, slices
from .suffix_sort import common_prefixes, suffix_array
from .words import Rolling, buffers

RANGE = 1 << 21
PLACE_BITS = 22
SHARD_BYTES = 1 << 20
LAST = (1 << 63) - 1
PLACES = "h long, c long, k1 long, k2 long, at long, n long"
NAMES = ["h", "c", "k1", "k2", "at", "n"]


def places(h, c, k1, k2, at, n, known=None) -> pa.RecordBatch:
    """Rows of PLACES; `h` is null for ranges that are removed already."""
    h = np.asarray(h).view(np.int64) if len(h) else np.empty(0, np.int64)
    return pa.RecordBatch.from_arrays(
        [pa.array(h, mask=known), pa.array(np.asarray(c).view(np.int64) if len(c) else np.empty(0, np.int64)),
         *(pa.array(np.asarray(x, np.int64)) for x in (k1, k2, at, n))], NAMES)


def merged(doc: np.ndarray, start: np.ndarray, end: np.ndarray):
    """Merge ranges of the same document that touch or overlap."""
    by = np.lexsort((start, doc))
    doc, start, end = doc[by], start[by], end[by]
    if not len(doc):
        return doc, start, end
    wide = int(end.max()) + 1
    reach = np.maximum.accumulate(doc * wide + end)
    new = np.concatenate([[True], doc[1:] * wide + start[1:] > reach[:-1]])
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(doc)]]) - 1
    return doc[first], start[first], reach[last] - doc[first] * wide


def segments(data: np.ndarray, offsets: np.ndarray, length: int, gram: int, rolling: Rolling):
    """(piece hash, content hash, text number, start, bytes) of all segments, range by range."""
    window = length - gram + 1
    texts = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    for low in range(0, len(data), RANGE):
        part = data[low:low + RANGE + length - 1]
        if len(part) < length:
            return
        prefix = rolling.prefix(part)
        at = np.arange(len(part) - gram + 1)
        grams = rolling.ranges(prefix, at, at + gram)
        key = grams & np.uint64(~((1 << PLACE_BITS) - 1) & (2**64 - 1)) | at.astype(np.uint64)
        least, width = key, 1
        while 2 * width <= window:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if width < window:
            least = np.minimum(least[:len(key) - window + 1], least[window - width:])
        piece = (least & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64)
        text = texts[low:low + len(piece)]
        valid = np.arange(low, low + len(piece)) + length <= offsets[text + 1]
        new = np.concatenate([[True], (piece[1:] != piece[:-1]) | (text[1:] != text[:-1])])
        first = np.flatnonzero(valid & (new | ~np.concatenate([[False], valid[:-1]])))
        ends = np.flatnonzero(valid & np.concatenate([new[1:] | ~valid[1:], [True]]))
        yield (grams[piece[first]], rolling.ranges(prefix, first, ends + length), text[first],
               low + first - offsets[text[first]], ends + length - first)


def list_segments(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling = Rolling()
        for batch in slices(batches, "text", RANGE):
            data, offsets = buffers(batch.column(2))
            k1, k2 = (batch.column(i).to_numpy() for i in (0, 1))
            by = np.lexsort((k2, k1))
            rank = np.empty(len(by), np.int64)  # equal keys are one document
            rank[by] = np.concatenate([[0], np.cumsum(
                (k1[by][1:] != k1[by][:-1]) | (k2[by][1:] != k2[by][:-1]))])[:len(by)]
            for h, c, text, at, n in segments(data, offsets, length, gram, rolling):
                order = np.lexsort((at, rank[text], c, h))
                h, c, text, at, n = (x[order] for x in (h, c, text, at, n))
                first = np.concatenate([[True], (h[1:] != h[:-1]) | (c[1:] != c[:-1])])[:len(h)]
                lead = np.flatnonzero(first)[np.cumsum(first) - 1] if len(h) else order
                more = (rank[text] != rank[text[lead]]) | (at != at[lead])
                doc, start, end = merged(text[more], at[more], at[more] + n[more])
                text, at, n, h, c = (x[first] for x in (text, at, n, h, c))
                yield places(h, c, k1[text], k2[text], at, n)
                yield places(np.zeros(len(doc), np.int64), np.zeros(len(doc), np.int64), k1[doc], k2[doc],
                             start, end - start, np.ones(len(doc), bool))
    return run


def sift(hot_segments: int):
    """By piece: ranges of repeated segments, and the first places of segments that differ.

    Rows come in order of piece, content and place. The segments of the last piece of a batch are held
    until the piece is over; a piece with too many is hot, and its segments are passed on at once.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.empty(0, np.int64)] * 6
        passed = 0  # of the held rows, those already passed on as hot
        for batch in batches:
            known = batch.filter(batch.column(0).is_null())
            if known.num_rows:
                yield with_count(known, np.zeros(known.num_rows, np.int64))
            batch = batch.filter(batch.column(0).is_valid())
            if not batch.num_rows:
                continue
            h, c, k1, k2, at, n = (np.concatenate([old, batch.column(i).to_numpy()])
                                   for i, old in enumerate(held))
            first = np.concatenate([[True], (h[1:] != h[:-1]) | (c[1:] != c[:-1])])
            lead = np.flatnonzero(first)[np.cumsum(first) - 1]
            more = np.flatnonzero((k1 != k1[lead]) | (k2 != k2[lead]) | (at != at[lead]))
            if len(more):
                zero = np.zeros(len(more), np.int64)
                yield with_count(places(zero, zero, k1[more], k2[more], at[more], n[more],
                                        np.ones(len(more), bool)), zero)
            rows = np.flatnonzero(first)
            kinds, group, count = np.unique(h[rows], return_inverse=True, return_counts=True)
            different = count[group]
            if passed:
                different[h[rows] == h[0]] = hot_segments + 1
            ready = (different > 1) & (h[rows] != h[-1])
            open_rows = rows[h[rows] == h[-1]]
            was_hot = passed and h[-1] == h[0]
            if was_hot or len(open_rows) > hot_segments:
                different[h[rows] == h[-1]] = hot_segments + 1
                ready |= h[rows] == h[-1]
                open_rows = open_rows[-1:]
                ready[:passed] = False
                passed = 1
            else:
                ready[:passed] = False
                passed = 0
            keep = rows[ready]
            yield with_count(places(h[keep], c[keep], k1[keep], k2[keep], at[keep], n[keep]), different[ready])
            held = [x[open_rows] for x in (h, c, k1, k2, at, n)]
        keep = slice(0, 0 if passed or len(held[0]) < 2 else None)
        yield with_count(places(*(x[keep] for x in held)), np.full(len(held[0][keep]), len(held[0])))
    return run


def with_count(rows: pa.RecordBatch, different: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [*rows.columns, pa.array(different, pa.int64())], [*NAMES, "different"])


def fetch(length: int, hot_segments: int):
    """Bytes of the wanted segments of each text; single strings for pieces that are hot."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling = Rolling()
        for batch in slices(batches, "text", 4 << 20):
            k1, k2 = (batch.column(i).to_numpy() for i in (0, 1))
            wanted = batch.column(3)
            rows = np.repeat(np.arange(batch.num_rows), wanted.value_lengths().to_numpy())
            wanted = wanted.flatten()
            data, offsets = buffers(batch.column(2))
            h, at, n, different = (wanted.field(i).to_numpy() for i in range(4))
            start = offsets[rows] + at
            hot = different > hot_segments
            cold = np.flatnonzero(~hot)
            yield segment_rows(
                h[cold], np.zeros(len(cold), np.int64), k1[rows[cold]], k2[rows[cold]], at[cold],
                [data[s:s + k].tobytes() for s, k in zip(start[cold], n[cold], strict=True)])
            if hot.any():
                count = n[hot] - length + 1
                step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                row, place = np.repeat(rows[hot], count), np.repeat(at[hot], count) + step
                prefix = rolling.prefix(data)
                first = offsets[row] + place
                whole = rolling.ranges(prefix, first, first + length)
                half = rolling.ranges(prefix, first, first + length // 2)
                yield segment_rows(whole.view(np.int64), half.view(np.int64), k1[row], k2[row],
                                   place, [None] * len(row))
    return run


SEGMENTS = "h long, c long, k1 long, k2 long, at long, body binary"


def segment_rows(h, c, k1, k2, at, body) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [*(pa.array(np.asarray(x, np.int64)) for x in (h, c, k1, k2, at)), pa.array(body, pa.binary())],
        ["h", "c", "k1", "k2", "at", "body"])


def repeated_in_shard(bodies: list[bytes], order: np.ndarray, at: np.ndarray, length: int):
    """(segment, first byte) of every string in a shard that also starts earlier.

    `order` ranks the documents of the segments, `at` is a segment's place in its document.
    """
    sizes = np.array([len(b) for b in bodies])
    data = np.frombuffer(b"\0".join(bodies) + b"\0", np.uint8)
    offsets = np.concatenate([[0], np.cumsum(sizes + 1)])
    text = data.astype(np.int64) + 2
    text[offsets[1:] - 1] = 1
    text = np.concatenate([text, [0]])
    present = np.zeros(258, bool)
    present[text] = True
    suffixes = suffix_array((np.cumsum(present) - 1)[text])[1:]
    shared = common_prefixes(data, suffixes, length)[suffixes] >= length
    owner = np.repeat(np.arange(len(bodies)), sizes + 1)
    whole = offsets[owner + 1] - 1 - np.arange(len(data)) >= length
    valid = whole[suffixes]
    run = np.cumsum(~shared)
    kept = np.flatnonzero(valid)
    run, place = run[kept], suffixes[kept]
    segment = owner[place]
    inside = at[segment] + place - offsets[segment]
    by = np.lexsort((inside, order[segment], run))
    run, segment, place, inside = run[by], segment[by], place[by], inside[by]
    first = np.concatenate([[True], run[1:] != run[:-1]])
    lead = np.flatnonzero(first)[np.cumsum(first) - 1]
    later = (order[segment] != order[segment[lead]]) | (inside != inside[lead])
    return segment[later], inside[later]


def sort_shards(length: int):
    """Removed ranges from segments in order of their piece, and from single strings."""
    def shard(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(rows)
        h, c, k1, k2, at = (table.column(i).to_numpy() for i in range(5))
        by = np.lexsort((k2, k1))
        rank = np.empty(len(by), np.int64)
        rank[by] = np.concatenate([[0], np.cumsum(
            (k1[by][1:] != k1[by][:-1]) | (k2[by][1:] != k2[by][:-1]))])[:len(by)]
        segment, place = repeated_in_shard(table.column(5).to_pylist(), rank, at, length)
        doc, start, end = merged(rank[segment], place, place + length)
        doc = by[np.searchsorted(rank[by], doc)]
        zero = np.zeros(len(doc), np.int64)
        return places(zero, zero, k1[doc], k2[doc], start, end - start, np.ones(len(doc), bool))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, size, last_string = [], 0, None
        for batch in batches:
            single = batch.filter(batch.column(5).is_null())
            if single.num_rows:  # ordered by hashes, document and place: the first of each stays
                h, c, k1, k2, at = (single.column(i).to_numpy() for i in range(5))
                new = np.concatenate([[(h[0], c[0]) != last_string], (h[1:] != h[:-1]) | (c[1:] != c[:-1])])
                last_string = h[-1], c[-1]
                later = np.flatnonzero(~new)
                zero = np.zeros(len(later), np.int64)
                yield places(zero, zero, k1[later], k2[later], at[later], zero + length,
                             np.ones(len(later), bool))
            batch = batch.filter(batch.column(5).is_valid())
            while batch.num_rows:
                h = batch.column(0).to_numpy()
                if waiting and size >= SHARD_BYTES:  # close the shard where the piece changes
                    end = int(np.searchsorted(h != waiting[-1].column(0)[-1].as_py(), True))
                    if end:
                        waiting.append(batch.slice(0, end))
                    if end < len(h):
                        yield shard(waiting)
                        waiting, size = [], 0
                    batch = batch.slice(end)
                    continue
                ends = np.cumsum(np.diff(buffers_of(batch.column(5))))
                take = int(np.searchsorted(ends, SHARD_BYTES - size)) + 1
                waiting.append(batch.slice(0, take))
                size += int(ends[min(take, len(ends)) - 1])
                batch = batch.slice(take)
        if waiting:
            yield shard(waiting)
    return run


def buffers_of(column: pa.Array) -> np.ndarray:
    return np.frombuffer(column.buffers()[1], np.int32)[column.offset:column.offset + len(column) + 1]


REPORT = "n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def report(id_col: str, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            ranges = batch.column(2)
            rows = np.repeat(np.arange(batch.num_rows), ranges.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
            flat = ranges.flatten()
            start = flat.field(0).to_numpy()
            doc, start, end = merged(rows, start, start + flat.field(1).to_numpy())
            at = np.searchsorted(doc, np.arange(batch.num_rows + 1))
            data, offsets = buffers(batch.column(1))
            data = data.tobytes()
            for k in range(batch.num_rows):
                body = data[offsets[k]:offsets[k + 1]]
                spans = list(zip(start[at[k]:at[k + 1]].tolist(), end[at[k]:at[k + 1]].tolist(), strict=True))
                kept, last = [], 0
                for a, b in spans:
                    kept.append(body[last:a])
                    last = b
                kept.append(body[last:])
                joined = b"".join(kept)
                out.append((len(body), len(body) - len(joined), len(spans),
                            hashlib.sha256(joined).hexdigest(), joined if with_text else None,
                            [{"start": a, "end": b} for a, b in spans] if with_text else None))
            columns = list(zip(*out, strict=True)) or [[]] * 6
            arrays = [batch.column(0), *(pa.array(x, pa.int64()) for x in columns[:3]),
                      pa.array(columns[3], pa.string())]
            names = [id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if with_text:
                arrays += [pa.array(columns[4], pa.binary()), pa.array(columns[5], pa.list_(
                    pa.struct([("start", pa.int64()), ("end", pa.int64())])))]
                names += ["kept", "spans"]
            yield pa.RecordBatch.from_arrays(arrays, names)
    return run


def remove_repeats(docs: DataFrame, length: int = 100, gram: int = 24, hot_segments: int = 20_000,
                   with_text: bool = False, id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """Per row: bytes, removed bytes and runs, digest of what is kept (and `kept`, `spans` on demand).

    A byte is removed if a string of `length` bytes that covers it also starts earlier: in a
    document with a smaller id, or earlier in the same one.

    * A null text counts as empty. The id is an integer; rows with a null id come after all others.
    * Rows that repeat an id are documents of their own, in the order of a hash of their text; rows
      that repeat id and text are one document, and all get its result.
    * An empty table gives an empty result. Other columns are not read.
    """
    spark = docs.sparkSession
    n = shuffle_tasks(spark)
    keyed = docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("k1"),
        F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("k2"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.col(id_col).alias("id"))
    listed = keyed.select("k1", "k2", "text").mapInArrow(list_segments(length, gram), PLACES)

    # The same plan stands below every use of a shuffled table, so each is shuffled once.
    dealt = listed.repartition(n, F.coalesce("h", F.xxhash64("k1", "k2", "at")))
    sifted = dealt.sortWithinPartitions("h", "c", "k1", "k2", "at").mapInArrow(
        sift(hot_segments), PLACES + ", different long")
    wanted = sifted.where("h is not null").groupBy("k1", "k2").agg(
        F.collect_list(F.struct("h", "at", "n", "different")).alias("wanted"))
    bodies = keyed.join(wanted, ["k1", "k2"]).select("k1", "k2", "text", "wanted", "id").mapInArrow(
        fetch(length, hot_segments), SEGMENTS)
    shards = bodies.repartition(n, "h").sortWithinPartitions("h", "c", "k1", "k2", "at")
    found = shards.mapInArrow(sort_shards(length), PLACES)

    removed = sifted.where("h is null").select("k1", "k2", "at", "n").unionByName(
        found.select("k1", "k2", "at", "n"))
    ranges = removed.groupBy("k1", "k2").agg(F.collect_list(F.struct("at", "n")).alias("ranges"))
    joined = keyed.join(ranges, ["k1", "k2"], "left").select(F.col("id").alias(id_col), "text", "ranges")
    kind = docs.schema[id_col].dataType.simpleString()
    more = ", kept binary, spans array<struct<start:long,end:long>>" * with_text
    return joined.mapInArrow(report(id_col, with_text), f"`{id_col}` {kind}, {REPORT}{more}")
