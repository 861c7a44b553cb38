"""Cross-product matrices of columns, summed up where the rows are."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EXPRESSION_LIMIT = 120


@dataclass(frozen=True)
class Gram:
    """Row count, column sums and sums of products."""

    n: int
    sums: np.ndarray
    products: np.ndarray

    def centred(self) -> np.ndarray:
        return self.products - np.outer(self.sums, self.sums) / max(self.n, 1)


def grams(df: DataFrame, columns: Sequence[str], masks: Sequence[str]) -> list[Gram]:
    """One Gram per boolean mask column over the rows where it holds, in one pass.

    Few sums stay aggregate expressions; many go through one numpy product per
    Arrow batch. Either way only the sums leave the executors.
    """
    d = len(columns)
    per_mask = 1 + d + d * (d + 1) // 2
    if per_mask * len(masks) <= EXPRESSION_LIMIT:
        flat = _by_expression(df, columns, masks)
    else:
        flat = _by_batch(df, columns, masks)
    out = []
    for part in np.split(np.asarray(flat, dtype=float), len(masks)):
        products = np.zeros((d, d))
        upper = np.triu_indices(d)
        products[upper] = part[1 + d:]
        products = products + np.triu(products, 1).T
        out.append(Gram(int(part[0]), part[1:1 + d], products))
    return out


def _by_expression(df, columns, masks) -> list[float]:
    terms = []
    for m in masks:
        inside = F.col(m)
        terms.append(F.count_if(inside).cast("double"))
        terms += [F.sum(F.when(inside, F.col(c))) for c in columns]
        terms += [F.sum(F.when(inside, F.col(a) * F.col(b)))
                  for i, a in enumerate(columns) for b in columns[i:]]
    row = df.agg(*[t.alias(f"t{i}") for i, t in enumerate(terms)]).first()
    return [v or 0.0 for v in row]


def _by_batch(df, columns, masks) -> list[float]:
    columns, masks = list(columns), list(masks)
    d = len(columns)
    upper = np.triu_indices(d)

    def partial(batches):
        total = 0.0
        for pdf in batches:
            x = pdf[columns].to_numpy(float)
            parts = []
            for m in masks:
                z = x[pdf[m].to_numpy(bool)]
                parts += [[len(z)], z.sum(axis=0), (z.T @ z)[upper]]
            total = total + np.concatenate(parts)
        if not np.isscalar(total):
            yield pd.DataFrame({"part": [total]})

    pieces = df.select(*columns, *masks).mapInPandas(partial, "part array<double>")
    rows = (pieces.select(F.posexplode("part").alias("i", "v"))
            .groupBy("i").agg(F.sum("v").alias("v")).collect())
    flat = np.zeros(len(masks) * (1 + d + len(upper[0])))
    for r in rows:
        flat[r["i"]] = r["v"]
    return flat.tolist()


def stacked_grams(df: DataFrame, sets: Sequence[Sequence[str]], mask: str) -> list[Gram]:
    """A Gram per set of columns (all of one length) over the rows of one mask, in one pass."""
    sets = [list(x) for x in sets]
    d = len(sets[0])
    upper = np.triu_indices(d)
    wanted = list(dict.fromkeys(c for x in sets for c in x))

    def partial(batches):
        total = 0.0
        for pdf in batches:
            inside = pdf[pdf[mask]]
            parts = [[len(inside)]]
            for columns in sets:
                z = inside[columns].to_numpy(float)
                parts += [z.sum(axis=0), (z.T @ z)[upper]]
            total = total + np.concatenate(parts)
        if not np.isscalar(total):
            yield pd.DataFrame({"part": [total]})

    pieces = df.select(*wanted, mask).mapInPandas(partial, "part array<double>")
    rows = pieces.select(F.posexplode("part").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v")).collect()
    flat = np.zeros(1 + len(sets) * (d + len(upper[0])))
    for r in rows:
        flat[r["i"]] = r["v"]
    out = []
    for part in np.split(flat[1:], len(sets)):
        products = np.zeros((d, d))
        products[upper] = part[d:]
        out.append(Gram(int(flat[0]), part[:d], products + np.triu(products, 1).T))
    return out


def pattern_grams(df: DataFrame, columns: Sequence[str], pattern: str) -> Mapping[int, np.ndarray]:
    """For each value of a whole-number column: the sums of products of (1, columns), in one pass.

    A task keeps a matrix for each value it meets; the caller bounds their number.
    """
    columns = list(columns)
    d = len(columns) + 1
    upper = np.triu_indices(d)

    def partial(batches):
        found: dict[int, np.ndarray] = {}
        for pdf in batches:
            x = np.column_stack([np.ones(len(pdf)), pdf[columns].to_numpy(float)])
            key = pdf[pattern].to_numpy(np.int64)
            order = np.argsort(key, kind="stable")
            cuts = np.flatnonzero(np.diff(key[order])) + 1
            for rows in np.split(order, cuts) if len(order) else []:
                z = x[rows]
                k = int(key[rows[0]])
                found[k] = found.get(k, 0.0) + (z.T @ z)[upper]
        if found:
            yield pd.DataFrame({"pattern": list(found), "part": list(found.values())})

    pieces = df.select(*columns, pattern).mapInPandas(partial, "pattern long, part array<double>")
    rows = (pieces.select("pattern", F.posexplode("part").alias("i", "v"))
            .groupBy("pattern", "i").agg(F.sum("v").alias("v"))
            .groupBy("pattern").agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("cells")).collect())
    out = {}
    for r in rows:
        matrix = np.zeros((d, d))
        matrix[upper] = [c["v"] for c in r["cells"]]
        out[r["pattern"]] = matrix + np.triu(matrix, 1).T
    return out
