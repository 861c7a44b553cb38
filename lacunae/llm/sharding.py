"""Consistent-hash ring with virtual nodes and bounded loads, in DataFrame functions only.

Every shard owns `virtual_nodes` points of a ring of 65,536 cells. A row hashes to a cell and wants
the shard of the next point clockwise; rows that meet a full shard go on clockwise to the next point
whose shard has room. Which rows of a cell stay is decided by their order of hash and key, so only
counts per cell (at most 65,536 numbers, whatever the input) reach the driver, and the placement is
a small table of runs per cell: one run per cell, and one more for each time that a shard fills up
within a cell, which happens once per shard.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CELL_BITS = 16
CELLS = 1 << CELL_BITS


def ring_owners(n_shards: int, virtual_nodes: int) -> list[tuple[int, int]]:
    """(cell, shard) of all virtual nodes in ring order; a shard's points don't depend on the others."""
    points = []
    for shard in range(n_shards):
        for node in range(virtual_nodes):
            digest = hashlib.blake2b(f"{shard}/{node}".encode(), digest_size=8).digest()
            points.append((int.from_bytes(digest, "big"), shard))
    return [(place >> (64 - CELL_BITS), shard) for place, shard in sorted(points)]


def capacities(total: int, n_shards: int, epsilon: float) -> list[int]:
    """Rows that each shard takes at most.

    With `epsilon` 0 the capacities add up to the rows, so the counts end at most one apart.
    """
    if epsilon > 0:
        return [math.ceil((1 + epsilon) * total / n_shards)] * n_shards
    return [total // n_shards + (shard < total % n_shards) for shard in range(n_shards)]


def place_cells(counts: dict[int, int], points: Sequence[tuple[int, int]],
                limits: Sequence[int]) -> list[tuple[int, int, int, int, int]]:
    """Runs (cell, first rank, end rank, shard, first slot) of all rows.

    In each round the waiting rows ask the shard of their point, in ring order; those that find
    it full move to the next point whose shard has room. A round ends with no rows waiting or
    with at least one more full shard.
    """
    room = list(limits)
    used = [0] * len(limits)
    runs: list[tuple[int, int, int, int, int]] = []
    waiting = []
    point = 0
    for cell in sorted(counts):
        while point < len(points) and points[point][0] < cell:
            point += 1
        waiting.append((cell, 0, counts[cell], point % len(points)))
    while waiting:
        over = []
        for cell, first, end, at in waiting:
            shard = points[at][1]
            take = min(room[shard], end - first)
            if take:
                runs.append((cell, first, first + take, shard, used[shard]))
                room[shard] -= take
                used[shard] += take
            if first + take < end:
                over.append((cell, first + take, end, at))
        waiting = []
        for cell, first, end, at in over:
            while not room[points[at][1]]:
                at = (at + 1) % len(points)
            waiting.append((cell, first, end, at))
    return runs


def shard_by_ring(docs: DataFrame, n_shards: int = 24, virtual_nodes: int = 128,
                  epsilon: float = 0.0, id_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """Shard and slot of every row, balanced by rows.

    Returns the id, `size` (UTF-8 bytes plus 8), `text_crc32`, `shard` and the gapless `slot` in it.

    * A null text has no bytes: size 8, checksum 0. A null id is placed by its text.
    * Rows that repeat an id and text are rows of their own and get slots of their own.
    * An empty table gives an empty result. Other columns are not read.
    """
    body = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    key = F.col(id_col).cast("string")
    rows = docs.select(
        F.col(id_col), (F.octet_length(body) + F.lit(8)).cast("long").alias("size"),
        F.crc32(body).alias("text_crc32"),
        F.xxhash64(F.coalesce(key, F.lit("")), F.when(key.isNull(), F.xxhash64(body)))
        .alias("_place"))
    rows = rows.withColumn("_cell", F.shiftrightunsigned("_place", 64 - CELL_BITS).cast("int"))

    counts = {r[0]: r[1] for r in rows.groupBy("_cell").count().collect()}
    limits = capacities(sum(counts.values()), n_shards, epsilon)
    runs = place_cells(counts, ring_owners(n_shards, virtual_nodes), limits)

    # Bounded by CELLS + n_shards rows, so it may be broadcast.
    plan = docs.sparkSession.createDataFrame(
        [(c, a, b, s, p) for c, a, b, s, p in runs],
        "_at int, _first long, _end long, shard int, _slot long")
    order = Window.partitionBy("_cell").orderBy("_place", id_col, "text_crc32", "size")
    ranked = rows.withColumn("_rank", F.row_number().over(order) - 1)
    placed = ranked.join(
        F.broadcast(plan),
        (F.col("_cell") == F.col("_at")) & (F.col("_rank") >= F.col("_first"))
        & (F.col("_rank") < F.col("_end")))
    return placed.select(
        id_col, "size", "text_crc32", "shard",
        (F.col("_slot") + F.col("_rank") - F.col("_first")).cast("long").alias("slot"))
