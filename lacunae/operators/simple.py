"""Fill values from column statistics."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .order import exact_quantiles, number
from .profile import numeric_columns

NO_CATEGORY = "missing"


def modes(df: DataFrame, columns: Sequence[str], fallback: str = NO_CATEGORY) -> dict[str, object]:
    """Most frequent value per column; the smallest one on a tie.

    Values are counted before they are compared, so no task holds a whole column.
    """
    if not columns:
        return {}
    cells = F.array(*[
        F.struct(F.lit(i).alias("c"), F.col(c).cast("string").alias("v"))
        for i, c in enumerate(columns)])
    counted = (df.select(F.inline(cells)).where(F.col("v").isNotNull())
               .groupBy("c", "v").agg(F.count(F.lit(1)).alias("n")))
    best = counted.groupBy("c").agg(F.min(F.struct(-F.col("n"), F.col("v"))).alias("b"))
    top = {r["c"]: r["b"]["v"] for r in best.collect()}
    return {c: top.get(i, fallback) for i, c in enumerate(columns)}


class FillModel:
    """Fill values per column; `transform` is a projection and also works on a stream."""

    def __init__(self, fills: dict[str, object]) -> None:
        self.fills = fills

    def transform(self, df: DataFrame) -> DataFrame:
        return df.select(*[self._filled(df, c).alias(c) for c in df.columns])

    def _filled(self, df: DataFrame, c: str):
        value = self.fills.get(c)
        if value is None:
            return F.col(c)
        kind = df.schema[c].dataType
        if isinstance(kind, T.NumericType):
            return F.coalesce(number(c), F.lit(float(value)))
        return F.coalesce(F.col(c), F.lit(value).cast(kind))

    def to_json(self) -> str:
        return json.dumps(self.fills, sort_keys=True)

    @classmethod
    def from_json(cls, text: str) -> FillModel:
        return cls(json.loads(text))


class MeanMode:
    """Mean of numeric columns, mode of the others."""

    name = "Mean/Mode"

    def __init__(self, keys: Sequence[str] = (), fallback: str = NO_CATEGORY) -> None:
        self.keys = keys
        self.fallback = fallback

    def _centres(self, df: DataFrame, columns: list[str]) -> dict[str, object]:
        row = df.agg(*[F.avg(number(c)).alias(f"m{i}") for i, c in enumerate(columns)]).first()
        return {c: row[f"m{i}"] for i, c in enumerate(columns)}

    def fit(self, df: DataFrame) -> FillModel:
        columns = [c for c in df.columns if c not in self.keys]
        numeric = [c for c in columns if c in numeric_columns(df)]
        fills = self._centres(df, numeric) if numeric else {}
        fills.update(modes(df, [c for c in columns if c not in numeric], self.fallback))
        return FillModel(fills)

    def fit_transform(self, df: DataFrame) -> DataFrame:
        return self.fit(df).transform(df)


class MedianMode(MeanMode):
    """Exact median of numeric columns, mode of the others."""

    name = "Median/Mode"

    def _centres(self, df: DataFrame, columns: list[str]) -> dict[str, object]:
        return {c: q and q[0] for c, q in exact_quantiles(df, columns, [0.5]).items()}
