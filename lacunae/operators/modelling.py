"""Shared preparation of the model-based imputers."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .encode import (
    MAP_LIMIT, category_codes, category_lists, decode, decode_by_join, encode, encode_by_join)
from .order import number
from .profile import numeric_columns

HOLE = "hole__"
CODE = "code__"


@dataclass
class Layout:
    """What the model columns are: numbers as they are, text as ordinal codes.

    Few categories are literals; many are a table of codes that is joined.
    """

    keys: list[str]
    numeric: list[str]
    categories: dict[str, list[str]]
    codes: dict[str, tuple[DataFrame, int]]
    n_rows: int = 0
    observed: dict[str, int] = field(default_factory=dict)
    mean: dict[str, float] = field(default_factory=dict)
    max_abs: float = 0.0

    @property
    def text(self) -> list[str]:
        return [*self.categories, *self.codes]

    @property
    def columns(self) -> list[str]:
        return [*self.numeric, *self.text]

    @property
    def holed(self) -> list[str]:
        """Columns with holes, fewest first."""
        missing = {c: self.n_rows - self.observed[c] for c in self.columns}
        return sorted((c for c in self.columns if missing[c]), key=lambda c: missing[c])

    def prepare(self, df: DataFrame) -> DataFrame:
        """The table with the joined codes that `value` refers to."""
        for c, (codes, _) in self.codes.items():
            df = encode_by_join(df, c, codes, CODE + c)
        return df

    def value(self, c: str) -> Column:
        if c in self.codes:
            return F.col(CODE + c)
        return encode(c, self.categories[c]) if c in self.categories else number(c)

    def code_of(self, c: str, label: str) -> float:
        if c in self.categories:
            return float(self.categories[c].index(label))
        return self.codes[c][0].where(F.col("value") == label).first()["code"]

    def n_categories(self, c: str) -> int:
        return len(self.categories[c]) if c in self.categories else self.codes[c][1]

    def finish(
        self, state: DataFrame, columns: Sequence[str], holed: Sequence[str],
        fill: Callable[[str], Column],
    ) -> DataFrame:
        """The original columns with holes replaced by `fill(c)`, codes back as labels."""
        def filled(c: str) -> Column:
            if c not in holed or c in self.codes:
                return F.col(c)
            known = number(c) if c in self.numeric else F.col(c)
            new = fill(c) if c in self.numeric else decode(fill(c), self.categories[c])
            return F.when(F.col(c).isNotNull(), known).otherwise(new)

        joined = [c for c in self.codes if c in holed]
        out = state.select(*[filled(c).alias(c) for c in columns],
                           *[fill(c).alias(CODE + c) for c in joined])
        for c in joined:
            out = decode_by_join(out, CODE + c, *self.codes[c], "_label")
            out = out.withColumn(c, F.coalesce(F.col(c), F.col("_label"))).drop("_label")
        return out.select(*columns)


def layout(df: DataFrame, keys: Sequence[str], limit: int = MAP_LIMIT) -> Layout:
    """Column kinds and observed means; columns without any value are left out."""
    keys = list(keys)
    numeric = [c for c in df.columns if c not in keys and c in numeric_columns(df)]
    text = [c for c in df.columns if c not in keys and c not in numeric]
    lists = category_lists(df, text, limit)
    codes = {}
    for c in (c for c, labels in lists.items() if labels is None):
        table = cut_lineage(category_codes(df, c))
        codes[c] = (table, table.count())
    plan = Layout(keys, numeric, {c: v for c, v in lists.items() if v}, codes)
    every = plan.columns
    aggs = [F.count(F.lit(1)).alias("n")]
    for i, c in enumerate(every):
        v = plan.value(c)
        aggs += [F.count(v).alias(f"n{i}"), F.avg(v).alias(f"m{i}"), F.max(F.abs(v)).alias(f"a{i}")]
    row = plan.prepare(df).agg(*aggs).first()
    plan.n_rows = row["n"]
    plan.observed = {c: row[f"n{i}"] for i, c in enumerate(every)}
    plan.mean = {c: row[f"m{i}"] for i, c in enumerate(every)}
    plan.max_abs = max((row[f"a{i}"] or 0.0 for i in range(len(every))), default=0.0)
    plan.numeric = [c for c in numeric if plan.observed[c]]
    return plan


def hole(c: str) -> str:
    return HOLE + c
