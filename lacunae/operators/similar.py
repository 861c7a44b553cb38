"""Most similar complete rows for each row to fill, exactly and without a cross join.

Similarity is the mean over the columns that both rows have: 1/(1+|q-c|/scale)
for numbers, equality for text. The complete rows are put into the cells of a tree
over all columns, whose number grows with the rows. A query first meets the rows
of its own cell. The k-th best of them is what another cell must be able to reach:
from a node's column ranges follows an upper bound of the similarity to anything
below it, and a query goes down the tree only where the bound allows. Large cells
are cut into blocks on both sides, and a block pair sends back at most k rows per query.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage
from .order import number
from .profile import numeric_columns, numeric_scales

MAX_CELLS = 16_384
SAMPLE_PER_CELL = 12
KNOWN_VALUES = 62
CELL_ROWS = 1_000
BLOCK_ROWS = 20_000
QUERY_STEP = 256
SLACK = 1e-9


def row_similarity(
    features: Sequence[str], scales: Mapping[str, float], query: str = "query_",
    candidate: str = "example_",
) -> Column:
    """Similarity of two rows that stand side by side; null when they share no column."""
    total, used = F.lit(0.0), F.lit(0.0)
    for c in features:
        q, e = F.col(query + c), F.col(candidate + c)
        if c in scales:
            q, e = number(q), number(e)
            part = F.lit(1.0) / (F.lit(1.0) + F.abs(q - e) / F.lit(scales[c]))
        else:
            part = (q == e).cast("double")
        both = q.isNotNull() & e.isNotNull()
        total = total + F.when(both, part).otherwise(F.lit(0.0))
        used = used + both.cast("double")
    return F.when(used > 0, total / used)


def _score(parts: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Mean of the column parts that both rows have; -inf where there is none."""
    total = np.zeros_like(parts[0][0])
    used = np.zeros_like(parts[0][0])
    for value, both in parts:
        total = total + np.where(both, value, 0.0)
        used = used + both
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(used > 0, total / used, -np.inf)


class CellTree:
    """Cells of the complete rows: a binary tree that splits the fullest cell by its widest column.

    Widths are measured in similarity, so a text column with several values is as wide as a number with a range far
    beyond its scale. Of a text column the `KNOWN_VALUES` most frequent values of the sample are told apart.
    """

    def __init__(self, sample: pd.DataFrame, numeric: list[str], text: list[str],
                 scales: Mapping[str, float], n_cells: int) -> None:
        self.numeric, self.text = numeric, text
        self.columns = [*numeric, *text]
        self.scales = np.array([scales[c] for c in numeric], float)
        self.codes = {c: {v: i for i, v in enumerate(sample[c].dropna().value_counts().index[:KNOWN_VALUES])}
                      for c in text}
        values, there = self.matrix(sample)
        self.column, self.cut, self.left = [-1], [0.0], [-1]
        heap = [(-len(sample), 0, np.arange(len(sample)))]
        leaves = 1
        while heap and leaves < n_cells:
            size, node, rows = heapq.heappop(heap)
            found = self._split(values[rows], there[rows])
            if -size < 2 or found is None:
                continue
            self.column[node], self.cut[node] = found
            self.left[node] = len(self.column)
            right = self._goes_right(values[rows], there[rows], np.full(len(rows), found[0]), np.full(len(rows), found[1]))
            for part in (rows[~right], rows[right]):
                heapq.heappush(heap, (-len(part), len(self.column), part))
                self.column.append(-1)
                self.cut.append(0.0)
                self.left.append(-1)
            leaves += 1
        self.column, self.cut, self.left = np.array(self.column), np.array(self.cut), np.array(self.left)

    def matrix(self, rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        """Numbers, and codes of text values, with what is there; unknown texts share the last code."""
        out = np.zeros((len(rows), len(self.columns)))
        there = np.zeros(out.shape, bool)
        for i, c in enumerate(self.columns):
            if c in self.text:
                there[:, i] = rows[c].notna().to_numpy()
                out[:, i] = rows[c].map(self.codes[c]).fillna(KNOWN_VALUES).to_numpy(float)
            else:
                v = rows[c].to_numpy(float)
                there[:, i] = ~np.isnan(v)
                out[:, i] = np.where(there[:, i], v, 0.0)
        return out, there

    def _split(self, values: np.ndarray, there: np.ndarray) -> tuple[int, float] | None:
        """(column, cut) of the widest column; a number is cut at its median, a text at its commonest value."""
        best, found = 0.0, None
        for i in range(len(self.columns)):
            v = values[there[:, i], i]
            missing = len(values) - len(v)
            if not len(v):
                continue
            if missing and len(v):  # a column that some rows lack is as wide as can be
                width, cut = 1.0 + min(missing, len(v)) / len(values), np.nan
            elif i < len(self.numeric):
                low, high = v.min(), v.max()
                if low == high:
                    continue
                inner = np.quantile(v, [0.1, 0.9])
                width = 1.0 - 1.0 / (1.0 + (inner[1] - inner[0]) / self.scales[i]) + 1e-6
                cut = np.median(v)
                if cut == high:  # the largest value goes right
                    cut = v[v < high].max()
            else:
                kinds, n = np.unique(v, return_counts=True)
                if len(kinds) < 2:
                    continue
                width, cut = 1.0 - n.max() / len(v) + 0.5, kinds[n.argmax()]
            if width > best:
                best, found = width, (i, float(cut))
        return found

    def _goes_right(self, values, there, column, cut) -> np.ndarray:
        at = np.arange(len(values))
        v, known = values[at, column], there[at, column]
        text = column >= len(self.numeric)
        side = np.where(text, v != cut, v > cut)
        return np.where(np.isnan(cut), ~known, known & side)

    def leaves(self, rows: pd.DataFrame) -> np.ndarray:
        """The cell of each row."""
        values, there = self.matrix(rows)
        at = np.zeros(len(rows), np.int64)
        open_ = np.arange(len(rows)) if self.left[0] >= 0 else np.empty(0, np.int64)
        while len(open_):
            node = at[open_]
            at[open_] = self.left[node] + self._goes_right(values[open_], there[open_], self.column[node], self.cut[node])
            open_ = open_[self.left[at[open_]] >= 0]
        return at

    def measure(self, stats: pd.DataFrame) -> None:
        """Take the ranges of all rows of each cell and join them up the tree.

        `stats` has `_cell`, `_n` and per column `__n` and `__lo`, `__hi` (numbers) or `__kinds` (texts, as bits).
        """
        m, d = len(self.column), len(self.columns)
        self.size = np.zeros(m)
        self.filled, self.low, self.high = np.zeros((m, d)), np.full((m, d), np.inf), np.full((m, d), -np.inf)
        self.kinds = np.zeros((m, d), np.uint64)
        at = stats["_cell"].to_numpy(np.int64)
        self.size[at] = stats["_n"]
        for i, c in enumerate(self.columns):
            self.filled[at, i] = stats[f"{c}__n"]
            if c in self.text:
                self.kinds[at, i] = stats[f"{c}__kinds"].to_numpy(np.int64).view(np.uint64)
            else:
                self.low[at, i] = stats[f"{c}__lo"].astype(float).fillna(np.inf)
                self.high[at, i] = stats[f"{c}__hi"].astype(float).fillna(-np.inf)
        for node in range(m - 1, -1, -1):
            if (k := self.left[node]) >= 0:
                self.size[node] = self.size[k] + self.size[k + 1]
                self.filled[node] = self.filled[k] + self.filled[k + 1]
                self.low[node] = np.minimum(self.low[k], self.low[k + 1])
                self.high[node] = np.maximum(self.high[k], self.high[k + 1])
                self.kinds[node] = self.kinds[k] | self.kinds[k + 1]

    def upper(self, values: np.ndarray, there: np.ndarray, node: np.ndarray) -> np.ndarray:
        """For each pair of a row and a node: no row of the node is more similar than this (-inf: none compares)."""
        d = len(self.numeric)
        part = np.zeros(values.shape)
        with np.errstate(invalid="ignore"):
            gap = np.maximum(np.maximum(self.low[node, :d] - values[:, :d], values[:, :d] - self.high[node, :d]), 0.0)
            part[:, :d] = 1.0 / (1.0 + gap / self.scales)
        bit = np.left_shift(np.uint64(1), values[:, d:].astype(np.uint64))
        part[:, d:] = (self.kinds[node, d:] & bit) != 0
        some = there & (self.filled[node] > 0)
        every = some & (self.filled[node] == self.size[node][:, None])
        total, used = np.where(every, part, 0.0).sum(axis=1), every.sum(axis=1).astype(float)
        # Of columns that only some rows have, the best ones count as long as they raise the mean.
        maybe = -np.sort(-np.where(some & ~every, part, -1.0), axis=1)
        with np.errstate(invalid="ignore", divide="ignore"):
            best = np.where(used > 0, total / used, -np.inf)
            for step in maybe.T:
                usable = step >= 0
                if not usable.any():
                    break
                total, used = np.where(usable, total + step, total), np.where(usable, used + 1, used)
                best = np.where(usable, np.maximum(best, total / used), best)
        return best

    def reachable(self, rows: pd.DataFrame, own: np.ndarray, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row number, cell) pairs whose cells, but for the row's own, may hold a row at least `floor` similar."""
        values, there = self.matrix(rows)
        row, node = np.arange(len(rows)), np.zeros(len(rows), np.int64)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        while len(row):
            bound = self.upper(values[row], there[row], node)
            stay = (bound >= floor[row] - SLACK) & np.isfinite(bound) & (self.size[node] > 0)
            row, node = row[stay], node[stay]
            leaf = self.left[node] < 0
            out = leaf & (node != own[row])
            found.append((row[out], node[out]))
            row, node = np.repeat(row[~leaf], 2), np.repeat(self.left[node[~leaf]], 2)
            node[1::2] += 1
        return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.empty(0, int),) * 2


def _few_copies(
    observed: DataFrame, keys: Sequence[str], features: Sequence[str], keep: int
) -> DataFrame:
    """Of rows with the same features, only the first `keep` by key can ever be chosen.

    Their similarity to any query is the same and ties go to the smaller key. The
    step is taken when at least half of the rows are such copies.
    """
    row = observed.agg(
        F.count(F.lit(1)).alias("n"),
        F.approx_count_distinct(F.xxhash64(*features)).alias("kinds")).first()
    if row["kinds"] * 2 > row["n"]:
        return observed
    copies = Window.partitionBy(*features).orderBy(*keys)
    return (observed.withColumn("_copy", F.row_number().over(copies))
            .where(F.col("_copy") <= keep).drop("_copy"))


def top_similar(
    queries: DataFrame,
    reference: DataFrame,
    keys: Sequence[str],
    target: str,
    features: Sequence[str],
    k: int,
    scales: Mapping[str, float] | None = None,
    block_rows: int = BLOCK_ROWS,
    cell_rows: int = CELL_ROWS,
) -> DataFrame:
    """The k most similar rows with a target for each query row, itself excluded.

    Returns the query keys, example_rank (1 = best; ties go to the smaller key),
    similarity and the example's columns as example_<column>.
    """
    keys, features = list(keys), [c for c in features if c != target]
    observed = reference.where(F.col(target).isNotNull()).select(*keys, target, *features)
    numeric = [c for c in features if c in numeric_columns(observed)]
    text = [c for c in features if c not in numeric]
    scales = dict(scales or numeric_scales(observed, numeric))
    numeric = [c for c in numeric if c in scales]
    schema = T.StructType([
        T.StructField("_query", T.LongType()), *[reference.schema[c] for c in keys],
        T.StructField("similarity", T.DoubleType()),
        *[T.StructField(f"example_{c}", reference.schema[c].dataType)
          for c in [*keys, target, *features]]])
    if k <= 0 or not (numeric or text):
        return queries.sparkSession.createDataFrame(
            [], T.StructType([*schema.fields[1:], T.StructField("example_rank", T.IntegerType())]))

    observed = _few_copies(observed, keys, features, k + 1)
    n_rows = observed.count()
    n_cells = min(MAX_CELLS, max(1, n_rows // max(cell_rows, 4 * (k + 1))))
    share = min(1.0, SAMPLE_PER_CELL * n_cells / max(n_rows, 1))
    shown = [*[number(c).alias(c) for c in numeric], *text]
    chosen = F.pmod(F.xxhash64(*keys), F.lit(1 << 30)) < int(share * (1 << 30))
    sample = observed.where(chosen).select(*shown).toPandas() if n_cells > 1 else observed.limit(0).select(*shown).toPandas()
    tree = CellTree(sample, numeric, text, scales, n_cells)

    def celled_rows(df: DataFrame, *more: Column) -> DataFrame:
        """The rows with their cells, stored: several steps read them."""
        slim = df.select(*df.columns, *[number(c).alias(f"_v_{c}") for c in numeric])

        def run(batches):
            for pdf in batches:
                pdf["_cell"] = tree.leaves(pdf.drop(columns=numeric).rename(columns={f"_v_{c}": c for c in numeric}))
                yield pdf.drop(columns=[f"_v_{c}" for c in numeric])

        return cut_lineage(slim.mapInPandas(run, T.StructType([*df.schema.fields, T.StructField("_cell", T.LongType())])
                                            ).select("*", *more))

    celled = celled_rows(observed)
    aggs = [F.count(F.lit(1)).alias("_n")]
    for c in numeric:
        v = number(c)
        aggs += [F.count(v).alias(f"{c}__n"), F.min(v).alias(f"{c}__lo"), F.max(v).alias(f"{c}__hi")]
    for c in text:
        bit = F.lit(KNOWN_VALUES)
        if tree.codes[c]:
            known = F.create_map(*[F.lit(x) for pair in tree.codes[c].items() for x in pair])
            bit = F.coalesce(F.try_element_at(known, F.col(c)), F.lit(KNOWN_VALUES))
        bits = F.bit_or(F.when(F.col(c).isNotNull(), F.call_function("shiftleft", F.lit(1).cast("long"), bit)))
        # Never null, or pandas would take the bits for floats.
        aggs += [F.count(c).alias(f"{c}__n"), F.coalesce(bits, F.lit(0).cast("long")).alias(f"{c}__kinds")]
    stats = celled.groupBy("_cell").agg(*aggs).toPandas()  # one row per cell
    tree.measure(stats)
    sizes = dict(zip(stats["_cell"].tolist(), stats["_n"].tolist()))

    asked = celled_rows(queries.select(*keys, *shown), F.monotonically_increasing_id().alias("_query"))

    def meet(routed: DataFrame) -> DataFrame:
        """The k best of each cell for the queries routed to it, in blocks of both sides."""
        hits = {r["_cell"]: r["n"] for r in routed.groupBy("_cell").agg(F.count(F.lit(1)).alias("n")).collect()}
        plan = [(c, math.ceil(sizes[c] / block_rows), math.ceil(n / block_rows)) for c, n in hits.items() if c in sizes]
        blocks = F.broadcast(queries.sparkSession.createDataFrame(plan, "_cell long, _rs long, _qs long"))

        def dealt(df: DataFrame, own: str, other: str, own_name: str, other_name: str) -> DataFrame:
            mine = F.pmod(F.xxhash64(*keys), F.col(own))
            copies = F.explode(F.sequence(F.lit(0).cast("long"), F.col(other) - 1))
            return df.join(blocks, "_cell").select(*df.columns, mine.alias(own_name), copies.alias(other_name))

        unit = ["_cell", "_r", "_q"]
        left = dealt(routed, "_qs", "_rs", "_q", "_r").groupBy(*unit)
        right = dealt(celled, "_rs", "_qs", "_r", "_q").groupBy(*unit)
        return left.cogroup(right).applyInPandas(best, schema)

    def best(qs: pd.DataFrame, refs: pd.DataFrame) -> pd.DataFrame:
        if qs.empty or refs.empty:
            return pd.DataFrame({f.name: [] for f in schema.fields})
        qs = qs.reset_index(drop=True)
        refs = refs.sort_values(keys, kind="stable").reset_index(drop=True)
        found = []
        for start in range(0, len(qs), QUERY_STEP):
            part = qs.iloc[start:start + QUERY_STEP]
            found.append(_best_of_block(part, refs, keys, numeric, text, scales, k))
        q, e, s = (np.concatenate(x) for x in zip(*found))
        out = qs[["_query", *keys]].iloc[q].reset_index(drop=True)
        out["similarity"] = s
        for c in [*keys, target, *features]:
            out[f"example_{c}"] = refs[c].iloc[e].to_numpy()
        return out

    # The own cell of a query gives a similarity that other cells must be able to reach.
    near = cut_lineage(meet(asked))
    near_k = Window.partitionBy("_query").orderBy(F.col("similarity").desc())
    near_best = near.withColumn("_place", F.row_number().over(near_k)).where(F.col("_place") == k).select(
        "_query", F.col("similarity").alias("_floor"))
    bounded = asked.join(near_best, "_query", "left")

    def route(batches):
        for pdf in batches:
            for start in range(0, len(pdf), QUERY_STEP):
                part = pdf.iloc[start:start + QUERY_STEP]
                q, cell = tree.reachable(part, part["_cell"].to_numpy(), part["_floor"].fillna(-np.inf).to_numpy())
                out = part.drop(columns="_floor").iloc[q].copy()
                out["_cell"] = cell
                yield out

    far = meet(cut_lineage(bounded.select(*asked.columns, "_floor").mapInPandas(route, asked.schema)))
    ranked = Window.partitionBy("_query").orderBy(
        F.col("similarity").desc(), *[F.col(f"example_{c}") for c in keys])
    found = near.unionByName(far).withColumn("example_rank", F.row_number().over(ranked))
    return found.where(F.col("example_rank") <= k).drop("_query")


def _best_of_block(part, refs, keys, numeric, text, scales, k):
    """(query row, reference row, similarity) of the k best per query within one block."""
    parts = []
    for c in numeric:
        q = part[c].to_numpy(float)[:, None]
        e = refs[c].to_numpy(float)[None, :]
        both = ~np.isnan(q) & ~np.isnan(e)
        with np.errstate(invalid="ignore"):
            parts.append((1.0 / (1.0 + np.abs(q - e) / scales[c]), both))
    for c in text:
        codes, _ = pd.factorize(pd.concat([part[c], refs[c]], ignore_index=True))
        q, e = codes[:len(part)][:, None], codes[len(part):][None, :]
        both = (q >= 0) & (e >= 0)
        parts.append(((q == e).astype(float), both))
    score = _score(parts)
    same = np.ones(score.shape, dtype=bool)
    for c in keys:
        same &= part[c].to_numpy()[:, None] == refs[c].to_numpy()[None, :]
    score = np.where(same, -np.inf, score)
    order = np.argsort(-score, axis=1, kind="stable")[:, :k]
    rows = np.repeat(part.index.to_numpy(), order.shape[1])
    cols = order.ravel()
    values = np.take_along_axis(score, order, axis=1).ravel()
    good = np.isfinite(values)
    return rows[good], cols[good], values[good]
