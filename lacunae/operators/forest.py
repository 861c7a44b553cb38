"""Iterated random forests, and the measure that stops them."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import store
from .modelling import Layout, hole, layout
from .profile import numeric_columns
from .simple import NO_CATEGORY, modes
from .trees import Growth, predicted, quantile_cuts

NOW, OLD = "now__", "old__"
ROW = "row__"


def convergence_delta(
    df: DataFrame, numeric: Mapping[str, str], categorical: Mapping[str, str] | None = None,
    old: str = OLD, new: str = NOW,
) -> tuple[float, float]:
    """(numeric, categorical) change between two iterations, over the masked cells.

    The mappings name the boolean hole column of each value column. NaN stands for
    a kind without masked cells.
    """
    categorical = categorical or {}
    zero = F.lit(0.0)
    moved, size, differ, cells = zero, zero, zero, zero
    seen = zero
    for c, mask in numeric.items():
        a, b, m = F.col(old + c), F.col(new + c), F.col(mask)
        moved = moved + F.when(m, (b - a) * (b - a)).otherwise(zero)
        size = size + F.when(m, b * b).otherwise(zero)
        seen = seen + m.cast("double")
    for c, mask in categorical.items():
        m = F.col(mask)
        other = F.rint(F.col(old + c)) != F.rint(F.col(new + c))
        differ = differ + (m & other).cast("double")
        cells = cells + m.cast("double")
    row = df.agg(F.sum(moved).alias("moved"), F.sum(size).alias("size"), F.sum(seen).alias("seen"),
                 F.sum(differ).alias("differ"), F.sum(cells).alias("cells")).first()
    numeric_delta = row["moved"] / (row["size"] if row["size"] > 0 else 1e-12) \
        if row["seen"] else math.nan
    categorical_delta = row["differ"] / row["cells"] if row["cells"] else math.nan
    return numeric_delta, categorical_delta


def should_stop(current: Sequence[float], previous: Sequence[float]) -> bool:
    """Every kind that is there has grown since the last iteration."""
    grown = [c > p for c, p in zip(current, previous) if not math.isnan(c)]
    return bool(grown) and all(grown)


class MissForest:
    """Mean/mode start, then one forest per holed column and iteration.

    Trees split at cuts between `max_bins` (256 at most) quantile bins. `max_features` is "sqrt", "log2", "onethird",
    "all", a share or a number. A task grows the parts of trees that hold about `task_rows` rows; in larger tables
    the parts above are grown on about `sample_rows` rows, `tops` of them for all trees (see `trees`).
    """

    name = "MissForest"

    def __init__(
        self, keys: Sequence[str] = (), seed: int = 42, n_estimators: int = 200,
        max_iter: int = 10, max_features: str = "sqrt", min_samples_leaf: int = 1,
        max_depth: int = 30, max_bins: int = 256, decreasing: bool = False,
        fallback: str = NO_CATEGORY, task_rows: int = 1_000_000, sample_rows: int = 200_000,
        tops: int = 4,
    ) -> None:
        if not 2 <= max_bins <= 256:
            raise ValueError("max_bins must be 2 to 256")
        self.keys, self.seed, self.max_iter = list(keys), seed, max_iter
        self.n_estimators, self.max_features = n_estimators, max_features
        self.min_samples_leaf, self.max_depth = min_samples_leaf, max_depth
        self.max_bins, self.decreasing, self.fallback = max_bins, decreasing, fallback
        self.task_rows, self.sample_rows, self.tops = task_rows, sample_rows, tops

    def fit(self, df: DataFrame) -> ForestModel:
        plan = layout(df, self.keys)
        text = [c for c in df.columns if c not in self.keys and c not in plan.numeric
                and df.schema[c].dataType.typeName() == "string"]
        fills = modes(df, text, self.fallback)
        # Columns without any value get a constant and take no part in the forests.
        empty = {c: fills[c] for c in text if c not in plan.text}
        empty.update({c: 0.0 for c in numeric_columns(df)
                      if c not in self.keys and c not in plan.numeric})
        fills.update({c: plan.mean[c] for c in plan.numeric})
        holed = plan.holed[::-1] if self.decreasing else plan.holed
        return ForestModel(self, plan, fills, holed, empty)

    def fit_transform(self, df: DataFrame) -> DataFrame:
        return self.fit(df).transform(df)


class ForestModel:
    """Start values and column order; `transform` grows the forests on the given table."""

    def __init__(
        self, settings: MissForest, plan: Layout, fills: dict, order: list[str], empty: dict
    ) -> None:
        self.settings, self.plan, self.fills, self.order = settings, plan, fills, order
        self.empty = empty
        self.history: list[dict] = []
        self.n_iter = 0

    def transform(self, df: DataFrame) -> DataFrame:
        plan = self.plan
        self.history, self.n_iter = [], 0
        if not self.order:
            return df.fillna(self.empty) if self.empty else df
        start = {}
        for c in plan.columns:
            first = self.fills[c]
            if c in plan.text:
                first = plan.code_of(c, first)
            start[hole(c)] = F.col(c).isNull()
            start[NOW + c] = F.coalesce(plan.value(c), F.lit(float(first)))
        # Every iteration reads the table many times: keep it once, with a number for each row.
        state = store(plan.prepare(df).withColumn(ROW, F.monotonically_increasing_id()),
                      *(plan.keys or plan.columns)).withColumns(start)
        columns = [NOW + c for c in plan.columns]
        self.cuts = dict(zip(columns, quantile_cuts(state, columns, self.settings.max_bins)))
        masks = {c: hole(c) for c in self.order}
        numeric = {c: m for c, m in masks.items() if c in plan.numeric}
        text = {c: m for c, m in masks.items() if c in plan.text}
        previous = (math.inf, math.inf)
        for iteration in range(self.settings.max_iter):
            state = state.withColumns({OLD + c: F.col(NOW + c) for c in self.order})
            for c in self.order:
                state = self._grow(state, c)
                if len(self.order) > 1:
                    state = store(state)
            delta = convergence_delta(state, numeric, text)
            stop = should_stop(delta, previous)
            self.history.append({
                "iteration": iteration + 1, "numeric_delta": delta[0],
                "categorical_delta": delta[1], "stopped": stop})
            if stop:
                state = state.withColumns({NOW + c: F.col(OLD + c) for c in self.order})
                break
            self.n_iter = iteration + 1
            # One holed column: same forest, same rows, so the next iteration changes nothing.
            if len(self.order) == 1 or all(math.isnan(x) or x == 0 for x in delta):
                break
            previous = tuple(p if math.isnan(d) else d for d, p in zip(delta, previous))
        out = plan.finish(state, df.columns, list(masks), lambda c: F.col(NOW + c))
        return out.fillna(self.empty) if self.empty else out

    def _grow(self, state: DataFrame, target: str) -> DataFrame:
        s, plan = self.settings, self.plan
        features = [NOW + c for c in plan.columns if c != target]
        if not features:
            return state
        how = Growth(s.n_estimators, s.seed, s.max_features, s.max_depth, s.min_samples_leaf, s.task_rows, s.sample_rows,
                     s.tops)
        n_classes = plan.n_categories(target) if target in plan.text else 0
        found = store(predicted(state, features, NOW + target, hole(target), ROW, [self.cuts[c] for c in features],
                                n_classes, plan.n_rows, how).withColumnRenamed("prediction", "predicted__"))
        # Only rows with holes are moved to meet their predictions.
        met = state.where(hole(target)).join(found, ROW, "left").withColumn(
            NOW + target, F.coalesce("predicted__", NOW + target)).select(*state.columns)
        return state.where(~F.col(hole(target))).unionByName(met)
