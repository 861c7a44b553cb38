"""Denoising autoencoder in closed form.

Marginalised denoising (Chen et al. 2012): instead of training on random copies
with a share of the observed cells set to zero, the expected second moments of
such copies are written down, so the best linear reconstruction follows from one
pass of sums. As in the trained form, the input is the scaled values next to the
observed marks, the loss counts only corrupted cells, and only holes are filled.

With more than one layer the reconstruction is stacked (as marginalised denoising is): the layer below is
denoised in closed form, spread over `units` seeded directions and bent by tanh; the last layer reads all of
them. A layer takes one pass of sums, and so does the readout, whose inputs are corrupted by a hash of the row,
because no closed form goes through the bend.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import splitmix
from .gram import grams
from .order import number
from .profile import numeric_columns

RIDGE = 1e-6
BENT_RIDGE = 1e-5


class DenoisingImputer:
    """Denoising reconstruction of numeric tables; linear with one layer."""

    name = "DAE"

    def __init__(
        self, keys: Sequence[str] = (), corruption: float = 0.2, seed: int = 42, layers: int = 1,
        units: int = 48,
    ) -> None:
        if not 0.0 <= corruption < 1.0:
            raise ValueError("The corruption rate must be in [0, 1).")
        if layers < 1 or units < 1:
            raise ValueError("There must be at least one layer and one unit.")
        self.keys, self.corruption, self.seed = list(keys), corruption, seed
        self.layers, self.units = layers, units

    def fit(self, df: DataFrame) -> DenoisingModel:
        columns = _numeric_only(df, self.keys)
        row = df.agg(F.count(F.lit(1)).alias("n"), *[
            a for i, c in enumerate(columns) for a in (
                F.count(number(c)).alias(f"n{i}"),
                F.coalesce(F.avg(number(c)), F.lit(0.0)).alias(f"m{i}"),
                F.coalesce(F.var_pop(number(c)), F.lit(0.0)).alias(f"v{i}"))]).first()
        n = max(row["n"], 1)
        mean = np.array([row[f"m{i}"] for i in range(len(columns))])
        # Spread of the mean-filled column: filled cells add nothing to the sum of squares.
        scale = np.sqrt([row[f"v{i}"] * row[f"n{i}"] / n for i in range(len(columns))])
        scale[scale == 0.0] = 1.0
        holed = [i for i, c in enumerate(columns) if 0 < row[f"n{i}"] < n]
        model = DenoisingModel(self.keys, columns, mean, scale, {})
        if holed and self.layers > 1:
            self._stack(df, model, holed)
        elif holed:
            self._solve(df, model, holed)
        return model

    def fit_transform(self, df: DataFrame) -> DataFrame:
        return self.fit(df).transform(df)

    def _solve(self, df: DataFrame, model: DenoisingModel, holed: list[int]) -> None:
        """Per holed column: moments over its observed rows, then one linear solve."""
        columns = model.columns
        # Marks of complete columns are constant and carry nothing.
        staged = df.select(
            *[model.scaled(i).alias(f"x{i}") for i in range(len(columns))],
            *[number(columns[i]).isNotNull().cast("double").alias(f"o{i}") for i in holed],
            *[number(columns[i]).isNotNull().alias(f"use{i}") for i in holed])
        inputs = [f"x{i}" for i in range(len(columns))] + [f"o{i}" for i in holed]
        keep = 1.0 - self.corruption
        for target, gram in zip(holed, grams(staged, inputs, [f"use{i}" for i in holed])):
            d = len(inputs)
            # Expected moments: a value survives with probability `keep`, a mark always.
            share = np.array([keep] * len(columns) + [1.0] * len(holed) + [1.0])
            moments = np.zeros((d + 1, d + 1))
            moments[:d, :d] = gram.products
            moments[:d, d] = moments[d, :d] = gram.sums
            moments[d, d] = gram.n
            expected = moments * np.outer(share, share)
            diagonal = np.arange(d + 1)
            expected[diagonal, diagonal] = np.diag(moments) * share
            # The loss looks at a cell only when it was corrupted: its own input is then zero.
            used = [j for j in range(d + 1) if j != target]
            a = expected[np.ix_(used, used)] + RIDGE * max(gram.n, 1) * np.eye(len(used))
            b = moments[used, target] * share[used]
            weights = np.linalg.solve(a, b)
            model.weights[target] = (
                {columns[j]: w for j, w in zip(used, weights) if j < len(columns)},
                {columns[holed[j - len(columns)]]: w for j, w in zip(used, weights)
                 if len(columns) <= j < d},
                float(weights[-1]))


    def _stack(self, df: DataFrame, model: DenoisingModel, holed: list[int]) -> None:
        """Layer after layer, then one readout per holed column."""
        keep, rng = 1.0 - self.corruption, np.random.default_rng(self.seed)
        staged = model.inputs(df, holed)
        stack = _Stack([])
        for _ in range(self.layers - 1):
            moments = _moments(staged, lambda x, marks, ids, stack=stack: [_with_one(stack.last(np.hstack([x, marks])))])[0]
            d = len(moments) - 1
            share = np.append(np.full(d, keep), 1.0)
            expected = moments * np.outer(share, share)
            expected[np.arange(d + 1), np.arange(d + 1)] = np.diag(moments) * share
            a = expected + RIDGE * max(moments[d, d], 1.0) * np.eye(d + 1)
            denoise = np.linalg.solve(a, (moments[:d] * share).T).T
            spread = rng.normal(0.0, 1.0 / np.sqrt(d), (self.units, d)) * 2.0
            stack = _Stack([*stack.layers, (denoise, spread, rng.uniform(-1.5, 1.5, self.units))])
        columns, seed, corruption = list(holed), self.seed, self.corruption

        def readout(x, marks, ids):
            """Features of corrupted rows without the target's own value, and that value."""
            out = []
            for place, target in enumerate(columns):
                rows = marks[:, place] > 0
                noisy = x[rows].copy()
                for j in range(x.shape[1]):
                    key = splitmix(np.array([(seed & 0xFFFFFFFF) * 4096 + j], np.uint64))
                    u = splitmix(ids[rows] ^ key) >> np.uint64(11)
                    noisy[u < np.uint64(int(corruption * (1 << 53))), j] = 0.0
                noisy[:, target] = 0.0
                seen = marks[rows].copy()
                seen[:, place] = 0.0  # as it will be in a hole
                features = stack.all(np.hstack([noisy, seen]))
                out.append(np.hstack([_with_one(features), x[rows, target][:, None]]))
            return out

        for target, moments in zip(holed, _moments(staged, readout)):
            d = len(moments) - 1
            a = moments[:d, :d] + BENT_RIDGE * max(moments[d - 1, d - 1], 1.0) * np.eye(d)
            model.readout[target] = np.linalg.solve(a, moments[:d, d])
        model.stack = stack


class _Stack:
    """Bent layers: (denoising matrix with a constant column, directions, offsets)."""

    def __init__(self, layers: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> None:
        self.layers = layers

    def _outputs(self, h: np.ndarray) -> list[np.ndarray]:
        out = [h]
        for denoise, spread, offset in self.layers:
            h = np.tanh((h @ denoise[:, :-1].T + denoise[:, -1]) @ spread.T + offset)
            out.append(h)
        return out

    def last(self, h: np.ndarray) -> np.ndarray:
        return self._outputs(h)[-1]

    def all(self, h: np.ndarray) -> np.ndarray:
        return np.hstack(self._outputs(h))


def _with_one(x: np.ndarray) -> np.ndarray:
    return np.hstack([x, np.ones((len(x), 1))])


def _split(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Scaled values and observed marks of staged rows."""
    return (pdf[[c for c in pdf.columns if c.startswith("x")]].to_numpy(float),
            pdf[[c for c in pdf.columns if c.startswith("o")]].to_numpy(float))


def _moments(staged: DataFrame, make) -> list[np.ndarray]:
    """Sums of products of each matrix that `make(values, marks, row hashes)` returns, in one pass."""
    def partial(batches):
        total = None
        for pdf in batches:
            parts = [z.T @ z for z in make(*_split(pdf), pdf["row"].to_numpy(np.int64).view(np.uint64))]
            total = parts if total is None else [a + b for a, b in zip(total, parts)]
        if total is not None:
            yield pd.DataFrame({"part": [np.concatenate([m.ravel() for m in total])],
                                "sizes": [[len(m) for m in total]]})

    pieces = staged.mapInPandas(partial, "part array<double>, sizes array<int>")
    cells = pieces.select("sizes", F.posexplode("part").alias("i", "v")).groupBy("i").agg(
        F.sum("v").alias("v"), F.first("sizes").alias("sizes")).collect()
    flat = np.zeros(len(cells))
    for r in cells:
        flat[r["i"]] = r["v"]
    out, at = [], 0
    for size in cells[0]["sizes"]:
        out.append(flat[at:at + size * size].reshape(size, size))
        at += size * size
    return out


class DenoisingModel:
    """Scaling and reconstruction weights; `transform` is a projection."""

    def __init__(self, keys, columns, mean, scale, weights) -> None:
        self.keys, self.columns = keys, columns
        self.mean, self.scale, self.weights = mean, scale, weights
        self.stack = _Stack([])
        self.readout: dict[int, np.ndarray] = {}

    def inputs(self, df: DataFrame, holed: Sequence[int], *more: str) -> DataFrame:
        """Scaled values x0, x1, …, the marks o… of holed columns and a hash of the row."""
        return df.select(
            *more, *[self.scaled(i).alias(f"x{i}") for i in range(len(self.columns))],
            *[number(self.columns[i]).isNotNull().cast("double").alias(f"o{i}") for i in holed],
            F.xxhash64(*(self.keys or self.columns)).alias("row"))

    def scaled(self, i: int):
        """Scaled value, 0 (the mean) in a hole."""
        z = (number(self.columns[i]) - F.lit(float(self.mean[i]))) / F.lit(float(self.scale[i]))
        return F.coalesce(z, F.lit(0.0))

    def transform(self, df: DataFrame) -> DataFrame:
        if _numeric_only(df, self.keys) != self.columns:
            raise ValueError("The columns differ from those of the fit, or their order does.")
        if self.readout:
            return self._transform_bent(df)
        place = {c: i for i, c in enumerate(self.columns)}
        fills = {}
        for target, (values, marks, level) in self.weights.items():
            out = F.lit(level)
            for c, w in values.items():
                out = out + F.lit(float(w)) * self.scaled(place[c])
            for c, w in marks.items():
                out = out + F.lit(float(w)) * number(c).isNotNull().cast("double")
            fills[self.columns[target]] = (
                out * F.lit(float(self.scale[target])) + F.lit(float(self.mean[target])))
        return df.select(*[
            F.coalesce(number(c), fills[c]).alias(c) if c in fills else F.col(c)
            for c in df.columns])


    def _transform_bent(self, df: DataFrame) -> DataFrame:
        holed = list(self.readout)
        staged = df.select("*", *[v.alias(c) for v, c in (
            *[(self.scaled(i), f"_x{i}") for i in range(len(self.columns))],
            *[(number(self.columns[i]).isNotNull().cast("double"), f"_o{i}") for i in holed])])
        stack, readout = self.stack, dict(self.readout)
        scale, mean = self.scale, self.mean
        inner = [c for c in staged.columns if c not in df.columns]

        def run(batches):
            for pdf in batches:
                features = _with_one(stack.all(np.hstack(_split(pdf[inner].rename(columns=lambda c: c[1:])))))
                out = pdf.drop(columns=inner)
                for i, weights in readout.items():
                    out[f"_fill{i}"] = features @ weights * scale[i] + mean[i]
                yield out

        filled = staged.mapInPandas(run, ", ".join(
            [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema] + [f"_fill{i} double" for i in holed]))
        fills = {self.columns[i]: F.col(f"_fill{i}") for i in holed}
        return filled.select(*[
            F.coalesce(number(c), fills[c]).alias(c) if c in fills else F.col(c) for c in df.columns])


def _numeric_only(df: DataFrame, keys: Sequence[str]) -> list[str]:
    columns = [c for c in df.columns if c not in keys]
    other = [c for c in columns if c not in numeric_columns(df)]
    if other:
        raise ValueError(f"Only numeric columns can be denoised; these are not: {other}.")
    return columns
