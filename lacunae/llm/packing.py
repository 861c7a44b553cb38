"""Packing of tokenised documents into sequences by bin completion.

Pieces are told apart by their length only, so the whole problem is a histogram of at most
`capacity` counts, whatever the input. The driver solves that: it takes the largest length left,
lists the undominated fillings of the rest of its sequence by rising waste, uses one as often as
the counts allow, and goes on; branches whose waste can no longer beat the best solution are cut.
Best-fit decreasing gives the first solution. The result is a table of patterns with numbers of
copies; each piece finds its place from its rank among the pieces of its length.
"""

from __future__ import annotations

import itertools
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import kept, slices, stored

Pattern = tuple[tuple[int, ...], int]
KNOWN = 1_600_000
RANK_ROWS = 100_000


# ---- tokens ----

class ChunkEncoder:
    """Ids of texts as little-endian 32-bit numbers, from ids of the chunks between single spaces.

    Holds for byte-level vocabularies whose pre-tokens start at a space between two other
    characters; any other tokenizer is given whole texts.
    """

    def __init__(self, path: str):
        import json
        import os
        import re

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        before = spec.get("pre_tokenizer") or {}
        added = spec.get("added_tokens") or []
        self.by_chunk = (
            before.get("type") == "ByteLevel" and before.get("use_regex", True)
            and not before.get("add_prefix_space") and not spec.get("normalizer")
            and spec["model"].get("type") == "BPE" and not spec.get("truncation")
            and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or " " in t["content"]
                        for t in added))
        self.special = [t["content"] for t in added]
        self.known: dict[str, bytes] = {}
        self.most_known = KNOWN
        self.double = re.compile(r"\s\s")
        self.space = re.compile(r"(?<=\S) (?=\S)")
        self.blank = re.compile(r"\s")
        vocabulary = self.tokenizer.get_vocab()
        self.opens = np.zeros(max(vocabulary.values()) + 1, bool)  # ids that begin with a space
        self.opens[[i for token, i in vocabulary.items() if token[0] == "Ġ"]] = True

    def _encode(self, texts: list[str]) -> Iterator[bytes]:
        for i in range(0, len(texts), 500):
            for found in self.tokenizer.encode_batch_fast(
                    texts[i:i + 500], add_special_tokens=False):
                yield array("I", found.ids).tobytes()

    def _learn(self, chunks: list[str]) -> None:
        """Ids of new chunks; those without white space are encoded in rows and cut at their spaces."""
        plain: list[str] = []
        odd: list[str] = []
        for c in chunks:
            (odd if not c or self.blank.search(c) else plain).append(c)
        rows = [plain[i:i + 200] for i in range(0, len(plain), 200)]
        for row, ids in zip(rows, self._encode([" " + " ".join(row) for row in rows]), strict=True):
            cuts = (4 * np.flatnonzero(self.opens[np.frombuffer(ids, np.uint32)])).tolist()
            if len(cuts) == len(row):
                self.known.update(zip(row, [ids[a:b] for a, b in itertools.pairwise([*cuts, len(ids)])]))
            else:
                odd.extend(row)
        self.known.update(zip(odd, self._encode([" " + c for c in odd]), strict=True))

    def __call__(self, texts: list[str]) -> list[bytes]:
        if not self.by_chunk:
            return list(self._encode(texts))
        parts = [self.space.split(t) if self.double.search(t) else t.split(" ") for t in texts]
        whole = [any(s in t for s in self.special) for t in texts]
        known = self.known
        if len(known) > self.most_known:
            known.clear()
        new: set[str] = set()
        heads: set[str] = set()
        for t, p, w in zip(texts, parts, whole, strict=True):
            heads.add(t if w else p[0])
            if not w:
                new.update(p)
        self._learn([c for c in new if c not in known])
        first = list(heads)
        opened = dict(zip(first, self._encode(first), strict=True))
        get = known.__getitem__
        out = []
        for t, p, w in zip(texts, parts, whole, strict=True):
            if w:
                out.append(opened[t])
            else:
                chunks = iter(p)
                out.append(opened[next(chunks)] + b"".join(map(get, chunks)))
        return out


def tokenised(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0,
              with_ids: bool = False, id_col: str = "doc_id",
              text_col: str = "text", cached_chunks: int = KNOWN) -> DataFrame:
    """Pieces of at most `capacity` tokens: id, piece, start, length, ids_crc32 (and ids, on demand).

    A document is its ids and `end_id`; one that is too long is cut from the end into full pieces, so
    only its first piece may be shorter. A null text counts as empty: the end id alone. A Python
    worker keeps the ids of about `cached_chunks` chunks of text (some 200 bytes each) for its next tasks.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = kept(f"ids {tokenizer_path}", lambda: ChunkEncoder(tokenizer_path))
        encode.most_known = cached_chunks
        end = array("I", [end_id]).tobytes()
        for batch in slices(batches, text_col, 4 << 20):
            rows, number, start, length, crc, body = [], [], [], [], [], []
            encoded = encode([t or "" for t in batch.column(1).to_pylist()])
            for row, ids in enumerate(encoded):
                ids += end
                n = len(ids) // 4
                first = n % capacity or capacity
                cuts = [0, *range(first, n + 1, capacity)]
                for k, (a, b) in enumerate(itertools.pairwise(cuts)):
                    part = ids[4 * a:4 * b]
                    rows.append(row)
                    number.append(k)
                    start.append(a)
                    length.append(b - a)
                    crc.append(zlib.crc32(part))
                    if with_ids:
                        body.append(np.frombuffer(part, "<u4").astype(np.int32))
            columns = [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(number, pa.int32()),
                       pa.array(start, pa.int64()), pa.array(length, pa.int64()),
                       pa.array(crc, pa.int64())]
            names = [id_col, "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns.append(pa.array(body, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long"
    return docs.select(id_col, text_col).mapInArrow(run, schema + ", ids array<int>" * with_ids)


# ---- plan ----

def best_fit(counts: np.ndarray, capacity: int) -> list[Pattern]:
    """Best-fit decreasing on counts per length."""
    open_bins: dict[int, list[list]] = {}  # room left: [lengths, copies]

    def add(room: int, lengths: tuple[int, ...], copies: int) -> None:
        open_bins.setdefault(room, []).append([lengths, copies])

    for size in np.flatnonzero(counts)[::-1].tolist():
        left = int(counts[size])
        while left:
            room = min((r for r in open_bins if r >= size), default=None)
            if room is None:
                each = capacity // size
                full, rest = divmod(left, each)
                if full:
                    add(capacity - each * size, (size,) * each, full)
                if rest:
                    add(capacity - rest * size, (size,) * rest, 1)
                break
            lengths, copies = open_bins[room].pop()
            if not open_bins[room]:
                del open_bins[room]
            fits = room // size  # a bin stays the best fit until nothing more goes in
            full = min(copies, left // fits)
            if full:
                add(room - fits * size, lengths + (size,) * fits, full)
                left -= full * fits
            if full < copies:
                if left and left < fits:
                    add(room - left * size, lengths + (size,) * left, 1)
                    left, full = 0, full + 1
                if full < copies:
                    add(room, lengths, copies - full)
    return [(tuple(lengths), copies) for bins in open_bins.values() for lengths, copies in bins]


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """Sequences that any packing needs: by the sum, and by lengths that cannot share (Martello, Toth)."""
    sizes = np.flatnonzero(counts)
    n = counts[sizes]
    best = -(-int((sizes * n).sum()) // capacity)
    for k in sizes[sizes <= capacity // 2].tolist() + [0]:
        alone = n[sizes > capacity - k].sum()
        large = (sizes > capacity // 2) & (sizes <= capacity - k)
        free = int((n[large] * (capacity - sizes[large])).sum())
        small = (sizes >= k) & (sizes <= capacity // 2)
        need = int((n[small] * sizes[small]).sum())
        best = max(best, int(alone + n[large].sum()) + max(0, -(-(need - free) // capacity)))
    return best


def fillings(counts: np.ndarray, room: int, width: int, most_waste: int) -> Iterator[tuple[tuple[int, ...], int]]:
    """Undominated fillings (lengths, waste) of `room`, least waste first, `width` at most.

    A single length fills better than any set that it could hold in its place, so nothing is
    listed beyond the waste of the largest single length; with equal waste fewer and larger lengths
    come first. Reachable sums of one to three lengths are bits of whole numbers.
    """
    sizes = np.flatnonzero(counts[:room + 1]).tolist()
    if not sizes:
        if room <= most_waste:
            yield (), room
        return
    one = sum(1 << x for x in sizes)
    two = three = 0
    mask = (1 << (room + 1)) - 1
    for x in sizes:
        two |= one << x
    two &= mask
    for x in sizes:
        three |= two << x
    given = 0
    reach = (one | two | three) & mask
    while reach:
        target = reach.bit_length() - 1
        if room - target > most_waste:
            return
        if target == sizes[-1]:
            yield (target,), room - target
            return
        chosen = split(counts, sizes, one, two, target)
        if chosen:
            yield chosen, room - target
            given += 1
            if given >= width:
                return
        reach &= ~(1 << target)


def split(counts: np.ndarray, sizes: list[int], one: int, two: int, target: int) -> tuple[int, ...] | None:
    """Two lengths or three that add up to `target`, the largest first."""
    def pair(rest: int, most: int) -> tuple[int, ...] | None:
        for x in range(min(most, rest - 1), (rest - 1) // 2, -1):
            if one >> x & 1 and one >> (rest - x) & 1 and (2 * x != rest or counts[x] > 1):
                return x, rest - x
        return None

    if two >> target & 1 and (found := pair(target, sizes[-1])):
        return found
    for x in reversed(sizes):
        if 3 * x < target:
            return None
        if x < target and two >> (target - x) & 1 and (found := pair(target - x, x)):
            chosen = (x, *found)
            if all(counts[y] >= chosen.count(y) for y in chosen):
                return chosen
    return None


def complete_bins(counts: np.ndarray, capacity: int, nodes: int = 4_000, width: int = 3,
                  fit_every: int = 64) -> list[Pattern]:
    """Fewest sequences found by branch and bound within `nodes` branches.

    Best fit gives the first solution, and one for the rest of every `fit_every`-th branch. The
    search ends early when the lower bound is met, which proves the solution optimal.
    """
    best = best_fit(counts, capacity)
    total = int((np.arange(len(counts)) * counts).sum())
    least = lower_bound(counts, capacity)
    used = sum(copies for _, copies in best)

    def branches(left: np.ndarray, waste: int) -> Iterator[tuple[tuple[int, ...], int, int]]:
        """Fillings of the sequence with the largest length, and how often each is used."""
        size = int(np.flatnonzero(left)[-1])
        rest = left.copy()
        rest[size] -= 1
        room = (used - 1) * capacity - total - waste
        for lengths, lost in fillings(rest, capacity - size, width, room):
            lengths = (size, *lengths)
            now = left.copy()
            for x in lengths:
                now[x] -= 1
            while lost:  # what is left of the room takes the largest length that fits
                fit = np.flatnonzero(now[:lost + 1])
                if not len(fit):
                    break
                lengths += (int(fit[-1]),)
                now[fit[-1]] -= 1
                lost -= int(fit[-1])
            kinds, times = np.unique(lengths, return_counts=True)
            copies = int((left[kinds] // times).min())
            if lost:
                copies = min(copies, room // lost)
            for n in sorted({copies, 1}, reverse=True) if copies > 0 else ():
                yield lengths, lost, n

    stack = [(counts.copy(), 0, 0, (), branches(counts, 0))]
    tried = 0
    while stack and tried < nodes and used > least:
        left, waste, spent, done, more = stack[-1]
        step = next(more, None)
        if step is None:
            stack.pop()
            continue
        lengths, lost, copies = step
        tried += 1
        now = left.copy()
        for x in lengths:
            now[x] -= copies
        waste, spent = waste + copies * lost, spent + copies
        if waste > (used - 1) * capacity - total:
            continue
        done = (done, (lengths, copies))
        if not now.any() or tried % fit_every == 0:
            rest = best_fit(now, capacity)
            found = spent + sum(n for _, n in rest)
            if found < used:
                best, used = [*unrolled(done), *rest], found
        if now.any():
            stack.append((now, waste, spent, done, branches(now, waste)))
    return best


def unrolled(chain: tuple) -> list[Pattern]:
    out = []
    while chain:
        chain, last = chain
        out.append(last)
    return out[::-1]


# ---- places ----

def place_table(patterns: list[Pattern]) -> tuple[np.ndarray, ...]:
    """For each run of ranks of a length: length, first rank, pieces a copy, first sequence, offset."""
    used: dict[int, int] = {}
    rows = []
    sequence = 0
    for lengths, copies in patterns:
        offset = 0
        for size, group in itertools.groupby(sorted(lengths, reverse=True)):
            each = len(list(group))
            first = used.get(size, 0)
            rows.append((size, first, each, sequence, offset))
            used[size] = first + copies * each
            offset += each * size
        sequence += copies
    rows.sort()
    return tuple(np.array(column, np.int64) for column in zip(*rows, strict=True))


def pack(pieces: DataFrame, capacity: int = 2048, nodes: int = 4_000,
         length_col: str = "length") -> DataFrame:
    """Add `sequence_id` and the gapless `offset` to every row of a table of pieces.

    * `length` must be 1 to `capacity`. Other columns are kept and may be null; they must not be
      called `sequence_id`, `offset`, `_cell`, `_rank` or `_base`.
    * Rows that repeat are packed as often as they are there. An empty table stays empty.
    * The rows are read three times: pass a stored table.
    """
    found = {r[0]: r[1] for r in pieces.groupBy(length_col).count().collect()}
    counts = np.zeros(capacity + 1, np.int64)
    for size, n in found.items():
        if not 1 <= size <= capacity:
            raise ValueError(f"length {size} is not 1 to {capacity}")
        counts[size] = n
    if not found:
        return pieces.withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")})
    table = pieces.sparkSession.sparkContext.broadcast(
        place_table(complete_bins(counts, capacity, nodes)))

    # Rank among the pieces of a length: rank in a cell of about RANK_ROWS rows, plus those before.
    cells = -(-int(counts.max()) // RANK_ROWS)
    celled = pieces.withColumn("_cell", F.pmod(F.xxhash64(*pieces.columns), F.lit(cells)))
    before = Window.partitionBy(length_col).orderBy("_cell").rowsBetween(
        Window.unboundedPreceding, -1)
    bases = celled.groupBy(length_col, "_cell").count().select(
        length_col, "_cell", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_base"))
    order = Window.partitionBy(length_col, "_cell").orderBy(*pieces.columns)
    ranked = celled.withColumn("_rank", F.row_number().over(order) - 1).join(
        bases, [length_col, "_cell"])
    ranked = ranked.select(*pieces.columns, (F.col("_rank") + F.col("_base")).alias("_rank"))
    at = pieces.columns.index(length_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes, firsts, each, sequences, offsets = table.value
        keys = sizes << 44 | firsts
        for batch in batches:
            size = batch.column(at).to_numpy(zero_copy_only=False).astype(np.int64)
            rank = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False)
            i = np.searchsorted(keys, size << 44 | rank, side="right") - 1
            copy, slot = np.divmod(rank - firsts[i], each[i])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(sequences[i] + copy), pa.array(offsets[i] + slot * size)],
                [*batch.schema.names[:-1], "sequence_id", "offset"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return ranked.mapInArrow(run, f"{fields}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0,
                   nodes: int = 4_000, id_col: str = "doc_id",
                   text_col: str = "text", cached_chunks: int = KNOWN) -> DataFrame:
    """Tokenise, cut and pack whole documents; one row per piece.

    * A null text counts as empty (the end id alone). A null id stays null; rows that repeat an id or a
      text are packed each by itself. An empty table gives an empty result.
    * The special strings of the vocabulary become their ids, as the library does by default.
    """
    pieces = tokenised(docs, tokenizer_path, capacity, end_id, False, id_col, text_col, cached_chunks)
    return pack(stored(pieces, "pieces"), capacity, nodes)
