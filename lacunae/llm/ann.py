"""Nearest neighbours by collision counting over single projections.

Inner products become distances by one more coordinate that gives all vectors of a block the length of
its longest one. A block of vectors has, for each of `projections` random directions, its vectors
sorted by projection. A query opens a window around its own projection in every array; vectors inside
collide with it. The windows of a query grow by the factor `growth` (virtual rehashing: the arrays stay, only
the ends of the windows move), and each vector that collides in a share `threshold` of all arrays is
verified by its inner product. A query is done when `verify_share` of the block and `k` more are verified, or
when `k` verified vectors are within the radius, which is the window's width by `WIDTH`: up to there nearly every
vector collides in enough arrays, beyond it many don't, so a k-th neighbour farther out may hide nearer ones.

Equal vectors are searched once. Vectors and queries are dealt into blocks of bounded size, and every
block of queries meets every block of vectors, so no task holds more than two blocks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored


# Width of a window for radius 1: vectors at this distance collide with a probability of 0.83.
WIDTH = 2.72


class CollisionIndex:
    """Sorted projections of a block of vectors."""

    def __init__(self, vectors: np.ndarray, projections: int, seed: int = 1):
        if len(vectors) >= 1 << 16:
            raise ValueError("a block holds fewer than 65,536 vectors")
        lengths = np.sqrt((vectors * vectors).sum(1))
        self.vectors = vectors
        scaled = vectors / lengths.max()
        rest = np.sqrt(np.maximum(0.0, 1 - (scaled * scaled).sum(1)))
        self.directions = np.random.default_rng(seed).standard_normal((vectors.shape[1] + 1, projections))
        values = scaled @ self.directions[:-1] + rest[:, None] * self.directions[-1]
        self.order = np.argsort(values, axis=0, kind="stable").T.copy()
        self.values = np.take_along_axis(values, self.order.T, 0).T.copy()
        self.ranks = np.empty(self.order.shape, np.uint16)  # place of each vector in each array
        np.put_along_axis(self.ranks, self.order, np.arange(len(vectors), dtype=np.uint16)[None, :], 1)
        self.longest = lengths.max()

    def search(self, queries: np.ndarray, k: int, threshold: float = 0.75, verify_share: float = 0.12,
               growth: float = 1.25, first_width: float = 1.6) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, vector, inner product) of all verified vectors among the best `k` of each query."""
        found = [], [], []
        for start in range(0, len(queries), 64):
            part = self._search(queries[start:start + 64], k, threshold, verify_share, growth, first_width)
            for out, new in zip(found, part, strict=True):
                out.append(new)
            found[0][-1] += start
        return tuple(np.concatenate(x) for x in found)

    def _search(self, queries, k, threshold, verify_share, growth, width):
        n, m = len(self.vectors), len(self.order)
        units = queries / np.sqrt((queries * queries).sum(1))[:, None]
        centres = units @ self.directions[:-1]
        least = max(1, int(threshold * m))
        enough = min(n, k + int(verify_share * n))
        scores = np.full((len(queries), n), -np.inf)
        live = np.arange(len(queries))
        while len(live):
            # A window is a range of places, so a vector collides where its place lies in the range.
            counts = np.zeros((len(live), n), np.uint8 if m < 256 else np.uint16)
            for j in range(m):
                low = np.searchsorted(self.values[j], centres[live, j] - width / 2)
                high = np.searchsorted(self.values[j], centres[live, j] + width / 2, side="right")
                inside = (self.ranks[j][None, :] - low.astype(np.uint16)[:, None]) < (
                    high - low).astype(np.uint16)[:, None]
                counts += inside.view(np.uint8)
            collide = counts >= least
            open_queries = []
            for row, q in enumerate(live.tolist()):
                chosen = np.flatnonzero(collide[row] & (scores[q] == -np.inf))
                scores[q, chosen] = self.vectors[chosen] @ queries[q]
                verified = scores[q] > -np.inf
                done = int(verified.sum())
                if done >= enough:
                    continue
                if done >= k:
                    # k-th best distance after scaling, against the radius reached
                    kth = np.partition(scores[q][verified], -k)[-k]
                    length = np.sqrt(queries[q] @ queries[q]) * self.longest
                    if np.sqrt(max(0.0, 2 - 2 * kth / length)) <= width / WIDTH:
                        continue
                if done < n:
                    open_queries.append(q)
            live = np.array(open_queries, np.int64)
            width *= growth
        rows, places = [], []
        for q in range(len(queries)):
            verified = np.flatnonzero(scores[q] > -np.inf)
            if len(verified) > k:  # ties of the k-th stay
                kth = np.partition(scores[q, verified], -k)[-k]
                verified = verified[scores[q, verified] >= kth]
            rows.append(np.full(len(verified), q))
            places.append(verified)
        rows, places = np.concatenate(rows), np.concatenate(places)
        return rows, places, scores[rows, places]


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def nearest(vectors: DataFrame, query_filter, k: int = 20, projections: int = 128,
            block_rows: int = 8192, query_rows: int = 4096, id_col: str = "vec_id",
            vector_col: str = "embedding", **search) -> DataFrame:
    """The `k` largest inner products found for every row where `query_filter` holds.

    Returns query_id, rank (from 1), the neighbour's id and score; ties go to the smaller id. A row is
    not its own neighbour. Scores are sums of double precision products of the original vectors.

    * Vectors that are null, zero or hold null or non-finite components, and rows with a null id, take
      no part; vectors meet only those of the same dimension.
    * Rows that repeat an id and vector count as one; those that repeat a vector are all neighbours.
    * An empty table, or no query, gives an empty result. Other columns are not read.
    """
    good = (F.col("v").isNotNull() & F.exists("v", lambda x: x != 0)
            & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"),
                          query_filter.alias("asks")).where(F.col("id").isNotNull()).where(good)
    rows = rows.distinct()
    by_vector = Window.partitionBy("v").orderBy("id")
    members = rows.select("id", "v").withColumn("place", F.row_number().over(by_vector)).where(
        F.col("place") <= k + 1)
    members = members.withColumn("one", F.min("id").over(Window.partitionBy("v")))
    members = stored(members, "members")
    distinct = members.where("place = 1").select(F.col("one"), "v", F.size("v").alias("dim"))
    asked = rows.where("asks").groupBy("v").agg(F.min("id").alias("q")).select(
        "q", "v", F.size("v").alias("dim"))

    n, n_asked = distinct.count(), asked.count()
    blocks, asks = max(1, -(-n // block_rows)), max(1, -(-n_asked // query_rows))
    left = distinct.withColumn("block", F.pmod(F.xxhash64("one"), F.lit(blocks))).withColumn(
        "ask", F.explode(F.sequence(F.lit(0), F.lit(asks - 1)).cast("array<long>")))
    right = asked.withColumn("ask", F.pmod(F.xxhash64("q"), F.lit(asks))).withColumn(
        "block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<long>")))

    def meet(table: pa.Table, queries: pa.Table) -> pa.Table:
        empty = pa.table({"q": pa.array([], pa.int64()), "one": pa.array([], pa.int64()),
                          "score": pa.array([], pa.float64())})
        if not table.num_rows or not queries.num_rows:
            return empty
        index = CollisionIndex(matrix(table["v"]), projections)
        q, at, score = index.search(matrix(queries["v"]), k + 1, **search)
        return pa.table({"q": queries["q"].combine_chunks().take(pa.array(q)),
                         "one": table["one"].combine_chunks().take(pa.array(at)), "score": score})

    keys = ["dim", "block", "ask"]
    hits = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(
        meet, "q long, one long, score double")
    # More classes than k + 1 may tie, but the smallest members of k + 1 classes are enough.
    best = Window.partitionBy("q").orderBy(F.desc("score"), "one")
    hits = hits.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k + 1)

    near = hits.select("q", "one", "score").join(members.select("one", "id"), "one")
    # Members of the classes of one query vector: the best k + 1, whoever asks.
    best = Window.partitionBy("q").orderBy(F.desc("score"), "id")
    near = near.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k + 1)
    who = rows.where("asks").select("v", F.col("id").alias("query_id")).join(asked.select("v", "q"), "v").select(
        "query_id", "q")
    out = who.join(near.select("q", "id", "score"), "q").where("id <> query_id")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    out = out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return out.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias(id_col), "score")
