"""Chained Bayesian ridge regressions.

A regression needs only sums of products. Rows with holes in the same columns form a
pattern, and a fill is the same linear function of the other columns for all rows of a
pattern, so the sums after a fill follow from those before it. One pass gathers the
sums per pattern, and all sweeps run on these matrices; a second pass replays them on the
rows with holes to see at which sweep the values have settled. Tables with too many
patterns, and posterior draws, whose noise is no linear function, go over the rows.

The prior of the ridge follows MacKay's evidence updates, with the public defaults of the
usual implementation.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import row_normal
from ..session import cut_lineage
from .gram import Gram, grams, pattern_grams, stacked_grams
from .modelling import Layout, hole, layout

# Hyper-prior, iteration limit and tolerance of the ridge; tolerance of a sweep.
PRIOR = 1e-6
RIDGE_STEPS = 300
RIDGE_TOLERANCE = 1e-3
SWEEP_TOLERANCE = 1e-3

NOW = "now__"
OLD = "old__"
PATTERN = "pattern__"
# Numbers that the matrices of all patterns may hold: 4 MB.
MATRIX_CELLS = 1 << 19


@dataclass(frozen=True)
class Ridge:
    """Prediction from columns in their own units, and its uncertainty."""

    columns: tuple[str, ...]
    centre: np.ndarray
    level: float
    weights: np.ndarray
    noise: float
    covariance: np.ndarray

    def mean(self, value) -> Column:
        out = F.lit(float(self.level - self.centre @ self.weights))
        for c, w in zip(self.columns, self.weights):
            out = out + F.lit(float(w)) * value(c)
        return out

    def deviation(self, value) -> Column:
        z = [value(c) - F.lit(float(m)) for c, m in zip(self.columns, self.centre)]
        total = F.lit(float(self.noise))
        for i in range(len(z)):
            for j in range(i, len(z)):
                share = float(self.covariance[i, j]) * (1.0 if i == j else 2.0)
                total = total + F.lit(share) * z[i] * z[j]
        return F.sqrt(F.greatest(total, F.lit(0.0)))


def evidence_ridge(
    gram: Gram, columns: Sequence[str], shift: Sequence[float]
) -> Ridge:
    """Ridge of the last Gram column on the others; `shift` was taken off every column."""
    n = gram.n
    centred = gram.centred()
    xx, xy, yy = centred[:-1, :-1], centred[:-1, -1], max(centred[-1, -1], 0.0)
    eigen, basis = np.linalg.eigh(xx)
    eigen = np.clip(eigen, 0.0, None)
    turned = basis.T @ xy
    noise_precision = 1.0 / (yy / n + np.finfo(float).eps)
    weight_precision = 1.0

    def solve():
        return basis @ (turned / (eigen + weight_precision / noise_precision))

    weights = solve()
    for step in range(RIDGE_STEPS):
        previous = weights
        weights = solve()
        error = max(yy - 2.0 * weights @ xy + weights @ xx @ weights, 0.0)
        scaled = noise_precision * eigen
        effective = np.sum(scaled / (weight_precision + scaled))
        weight_precision = (effective + 2 * PRIOR) / (np.sum(weights**2) + 2 * PRIOR)
        noise_precision = (n - effective + 2 * PRIOR) / (error + 2 * PRIOR)
        if step and np.sum(np.abs(previous - weights)) < RIDGE_TOLERANCE:
            break
    weights = solve()
    spread = basis @ np.diag(
        1.0 / (eigen + weight_precision / noise_precision)) @ basis.T / noise_precision
    centre = gram.sums / n + np.asarray(shift, dtype=float)
    return Ridge(tuple(columns), centre[:-1], float(centre[-1]), weights,
                 1.0 / noise_precision, spread)


class Mice:
    """Fill every column from all others, column by column, until the values settle."""

    name = "MICE"

    def __init__(
        self, keys: Sequence[str] = (), seed: int = 42, max_iter: int = 10,
        sample_posterior: bool = False, n_imputations: int = 1,
    ) -> None:
        self.keys, self.seed, self.max_iter = list(keys), seed, max_iter
        self.sample_posterior, self.n_imputations = sample_posterior, n_imputations
        if sample_posterior and n_imputations > 1:
            self.name = f"MICE posterior mean (m={n_imputations})"

    def fit(self, df: DataFrame) -> MiceModel:
        plan = layout(df, self.keys)
        steps = [] if self.sample_posterior else self._regressions(_start(df, plan), plan)
        return MiceModel(self, plan, steps)

    def fit_transform(self, df: DataFrame) -> DataFrame:
        plan = layout(df, self.keys)
        state = _start(df, plan)
        if not plan.holed or len(plan.columns) < 2:
            return _finish(state, df, plan, lambda c: F.col(NOW + c))
        if self.sample_posterior:
            return self._draw(state, df, plan)
        if len(plan.holed) > 1:
            state = cut_lineage(state, *(plan.keys or plan.columns))
        steps = self._regressions(state, plan)
        return _finish(_applied(state, plan, steps), df, plan, lambda c: F.col(NOW + c))

    def _regressions(self, state: DataFrame, plan: Layout) -> list[tuple[str, Ridge]]:
        """The regressions in the order in which they are applied."""
        holed = plan.holed
        if not holed or len(plan.columns) < 2:
            return []
        if len(holed) == 1:
            # The predictors never change: all sweeps are the same.
            return [(holed[0], _regress(state, plan, [NOW])[holed[0]][0])]
        pattern = sum((F.when(F.col(hole(c)), F.lit(1 << i)).otherwise(F.lit(0)) for i, c in enumerate(holed)),
                      F.lit(0).cast("long"))
        most = MATRIX_CELLS // (len(plan.columns) + 1) ** 2 if len(holed) < 63 else 0
        if most and state.select(pattern.alias(PATTERN)).distinct().limit(most + 1).count() <= most:
            return self._by_pattern(state.withColumn(PATTERN, pattern), plan)
        return self._by_rows(state, plan)

    def _by_pattern(self, state: DataFrame, plan: Layout) -> list[tuple[str, Ridge]]:
        columns, holed = plan.columns, plan.holed
        shift = np.array([plan.mean[c] for c in columns])
        shifted = state.select(*[(F.col(NOW + c) - F.lit(float(plan.mean[c]))).alias(c) for c in columns], PATTERN)
        found = pattern_grams(shifted, columns, PATTERN)
        sums = np.stack(list(found.values()))
        keys = np.array(list(found), np.int64)
        steps: list[tuple[str, Ridge]] = []
        for _ in range(self.max_iter):
            for bit, c in enumerate(holed):
                at = columns.index(c) + 1
                others = [i for i in range(1, len(columns) + 1) if i != at]
                lacks = (keys >> bit & 1).astype(bool)
                total = sums[~lacks].sum(axis=0)
                use = [*others, at]
                names = [columns[i - 1] for i in use]
                ridge = evidence_ridge(Gram(int(round(total[0, 0])), total[0, use], total[np.ix_(use, use)]),
                                       names[:-1], shift[[i - 1 for i in use]])
                steps.append((c, ridge))
                # The fill as a function of (1, columns), all shifted.
                fill = np.zeros(len(columns) + 1)
                fill[others] = ridge.weights
                fill[0] = ridge.level - shift[at - 1] + ridge.weights @ (shift[[i - 1 for i in others]] - ridge.centre)
                mine = sums[lacks]
                new = mine @ fill
                new[:, at] = new @ fill
                mine[:, at, :] = mine[:, :, at] = new
                sums[lacks] = mine
        settled = self._settled(state.where(F.col(PATTERN) > 0), plan, steps)
        return steps[:settled * len(holed)]

    def _settled(self, holes: DataFrame, plan: Layout, steps: list[tuple[str, Ridge]]) -> int:
        """The number of sweeps until no row changes by more than the tolerance."""
        replay, each, columns = _replayed(plan, steps), len(plan.holed), plan.columns
        n_sweeps = len(steps) // each

        def run(batches):
            most = np.zeros(n_sweeps)
            for pdf in batches:
                x, holes_ = _matrix(pdf, columns)
                before = x.copy()
                for sweep in range(len(most)):
                    replay(x, holes_, sweep * each, (sweep + 1) * each)
                    most[sweep] = max(most[sweep], np.abs(x - before).sum(axis=1).max(initial=0.0))
                    before[:] = x
            yield pd.DataFrame({"sweep": np.arange(len(most)), "moved": most})

        moved = holes.select(*[NOW + c for c in plan.columns], *[hole(c) for c in plan.columns]).mapInPandas(
            run, "sweep int, moved double").groupBy("sweep").agg(F.max("moved").alias("moved")).collect()
        still = [r["sweep"] + 1 for r in moved if r["moved"] < SWEEP_TOLERANCE * plan.max_abs]
        return min(still, default=len(steps) // each)

    def _by_rows(self, state: DataFrame, plan: Layout) -> list[tuple[str, Ridge]]:
        """One aggregation per regression and one checkpoint per sweep."""
        steps: list[tuple[str, Ridge]] = []
        for _ in range(self.max_iter):
            state = state.withColumns({OLD + c: F.col(NOW + c) for c in plan.holed})
            for c in plan.holed:
                ridge = _regress(state, plan, [NOW], c)[c][0]
                steps.append((c, ridge))
                state = _updated(state, c, NOW, ridge.mean(lambda x: F.col(NOW + x)))
            state = cut_lineage(state)
            if _moved(state, plan.holed) < SWEEP_TOLERANCE * plan.max_abs:
                break
        return steps

    def _draw(self, state: DataFrame, df: DataFrame, plan: Layout) -> DataFrame:
        """Mean of the posterior draws. A pass over the rows serves one regression of all draws."""
        holed = plan.holed
        single = len(holed) == 1
        draws = [f"draw{i}__" for i in range(self.n_imputations)]
        state = state.withColumns({d + c: F.col(NOW + c) for d in draws for c in plan.columns})
        if not single:
            state = cut_lineage(state, *(plan.keys or plan.columns))
        # With one holed column its predictors never change: the last sweep equals the first.
        for sweep in [self.max_iter - 1] if single else range(self.max_iter):
            for c in holed:
                # The draws of a single column have the same regression.
                ridges = _regress(state, plan, draws[:1] if single else draws, c)[c]
                for i, d in enumerate(draws):
                    ridge = ridges[0 if single else i]
                    z = row_normal(self.seed + i, plan.keys, f"{c}:{sweep}")

                    def value(x, d=d):
                        return F.col(d + x)

                    state = _updated(state, c, d, ridge.mean(value) + z * ridge.deviation(value))
            if not single:
                state = cut_lineage(state)

        def mean(c: str) -> Column:
            return sum((F.col(d + c) for d in draws[1:]), F.col(draws[0] + c)) / len(draws)

        return _finish(state, df, plan, mean)


def _updated(state: DataFrame, c: str, prefix: str, fill: Column) -> DataFrame:
    return state.withColumn(prefix + c, F.when(F.col(hole(c)), fill).otherwise(F.col(prefix + c)))


def _start(df: DataFrame, plan: Layout) -> DataFrame:
    """The table with number columns filled by the mean, and hole marks."""
    values = {c: plan.value(c) for c in plan.columns}
    return plan.prepare(df).withColumns({
        **{hole(c): v.isNull() for c, v in values.items()},
        **{NOW + c: F.coalesce(v, F.lit(float(plan.mean[c]))) for c, v in values.items()}})


def _regress(state: DataFrame, plan: Layout, prefixes: Sequence[str], target: str | None = None) -> dict[str, list[Ridge]]:
    """For the target (the only holed column), a regression per set of value columns."""
    target = target or plan.holed[0]
    predictors = [c for c in plan.columns if c != target]
    columns = [*predictors, target]
    shift = [plan.mean[c] for c in columns]
    shifted = state.select(
        *[(F.col(p + c) - F.lit(float(plan.mean[c]))).alias(p + c) for p in prefixes for c in columns],
        (~F.col(hole(target))).alias("use"))
    if len(prefixes) == 1:
        found = grams(shifted, [prefixes[0] + c for c in columns], ["use"])
    else:
        found = stacked_grams(shifted, [[p + c for c in columns] for p in prefixes], "use")
    return {target: [evidence_ridge(g, predictors, shift) for g in found]}


def _moved(state: DataFrame, holed: Sequence[str]) -> float:
    """Largest change of any row in the last sweep."""
    change = sum((F.abs(F.col(NOW + c) - F.col(OLD + c)) for c in holed), F.lit(0.0))
    return state.agg(F.max(change)).first()[0] or 0.0


def _finish(state: DataFrame, df: DataFrame, plan: Layout, fill) -> DataFrame:
    return plan.finish(state, df.columns, plan.holed, fill)


def _matrix(pdf: pd.DataFrame, columns: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    return (np.array(pdf[[NOW + c for c in columns]], float), np.array(pdf[[hole(c) for c in columns]], bool))


def _replayed(plan: Layout, steps: Sequence[tuple[str, Ridge]]):
    """A function that applies the steps from one number to another to a matrix of rows."""
    place = {c: i for i, c in enumerate(plan.columns)}
    known = [(place[c], [place[x] for x in r.columns], r.weights, r.level - float(r.centre @ r.weights))
             for c, r in steps]

    def run(x: np.ndarray, holes: np.ndarray, first: int = 0, last: int | None = None) -> None:
        for target, used, weights, level in known[first:last]:
            rows = np.flatnonzero(holes[:, target])
            x[rows, target] = x[np.ix_(rows, used)] @ weights + level

    return run


def _applied(state: DataFrame, plan: Layout, steps: Sequence[tuple[str, Ridge]]) -> DataFrame:
    """All regressions in one pass; a row's result depends on that row alone."""
    if len(steps) == 1:
        (c, ridge), = steps
        return _updated(state, c, NOW, ridge.mean(lambda x: F.col(NOW + x)))
    replay, columns = _replayed(plan, steps), plan.columns

    def run(batches):
        for pdf in batches:
            x, holes = _matrix(pdf, columns)
            replay(x, holes)
            pdf[[NOW + c for c in columns]] = x
            yield pdf

    return state.mapInPandas(run, state.schema) if steps else state


class MiceModel:
    """Fitted regressions in the order in which they were applied."""

    def __init__(self, settings: Mice, plan: Layout, steps: list[tuple[str, Ridge]]) -> None:
        self.settings, self.plan, self.steps = settings, plan, steps

    def transform(self, df: DataFrame) -> DataFrame:
        """Apply the regressions to any table with these columns.

        Posterior draws are made anew for the given table.
        """
        if self.settings.sample_posterior:
            return self.settings.fit_transform(df)
        holed = list(dict.fromkeys(c for c, _ in self.steps))
        state = _applied(_start(df, self.plan), self.plan, self.steps)
        return self.plan.finish(state, df.columns, holed, lambda c: F.col(NOW + c))
