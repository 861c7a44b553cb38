"""Column typing, null profiles, target choice and summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .order import exact_quantiles, number


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]


# A cast alone would take number literals of programming languages, such as 12d, 7F and 0x1p3.
DECIMAL = r"(?i)^[+-]?((\d+\.?\d*|\.\d+)(e[+-]?\d+)?|inf|infinity)$"


def text_number(col: Column) -> Column:
    """Trimmed text as a decimal number; anything else, the empty text and NaN are null."""
    text = F.trim(col)
    return F.when(text.rlike(DECIMAL), text.try_cast("double"))


def numeric_share(df: DataFrame, exclude: Sequence[str] = ()) -> dict[str, float]:
    """Share of all rows that parse as a number, per text column, in one pass."""
    columns = [c for c in text_columns(df) if c not in exclude]
    if not columns:
        return {}
    row = df.agg(*[
        F.avg(text_number(F.col(c)).isNotNull().cast("double")).alias(f"s{i}")
        for i, c in enumerate(columns)]).first()
    return {c: row[f"s{i}"] or 0.0 for i, c in enumerate(columns)}


def coerce_numeric(
    df: DataFrame, exclude: Sequence[str] = (), threshold: float = 0.95
) -> DataFrame:
    """Turn text columns into numbers where at least `threshold` of the rows parse."""
    shares = numeric_share(df, exclude)
    turn = {c for c, share in shares.items() if share >= threshold}
    return df.select(*[
        text_number(F.col(c)).alias(c) if c in turn else F.col(c) for c in df.columns])


def detect_id_columns(df: DataFrame, explicit: Sequence[str] = ()) -> set[str]:
    """Columns named like identifiers, and the explicit ones that exist."""
    def looks_like_id(name: str) -> bool:
        n = name.strip().lower()
        return n.endswith("id") or n.startswith("id_") or "_id" in n

    return {c for c in df.columns if looks_like_id(c) or c in explicit}


def feature_columns(df: DataFrame, target: str, ids: Sequence[str] = ()) -> list[str]:
    return [c for c in df.columns if c != target and c not in ids]


def null_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column_name, null_count, null_fraction), one scan."""
    columns = list(columns or df.columns)
    counts = df.agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.count_if(F.col(c).isNull()).alias(f"_{i}") for i, c in enumerate(columns)])
    cells = F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(f"_{i}").alias("null_count"))
        for i, c in enumerate(columns)])
    return counts.select("_n", F.inline(cells)).select(
        "column_name", "null_count",
        F.try_divide(F.col("null_count").cast("double"), F.col("_n")).alias("null_fraction"))


def null_counts(df: DataFrame, columns: Sequence[str] | None = None) -> dict[str, int]:
    return {r["column_name"]: r["null_count"] for r in null_profile(df, columns).collect()}


def resolve_targets(
    df: DataFrame, ids: Sequence[str] = (), mode: str = "primary_missing",
    explicit: Sequence[str] | None = None,
) -> list[str]:
    """Numeric columns with holes to be predicted."""
    if mode not in ("primary_missing", "all_missing_numeric", "explicit"):
        raise ValueError(f"Unknown target mode '{mode}'.")
    numeric = set(numeric_columns(coerce_numeric(df, exclude=list(ids)))) - set(ids)
    if mode == "explicit":
        if not explicit:
            raise ValueError("The mode 'explicit' needs target columns.")
        return [c for c in explicit if c in numeric]
    nulls = null_counts(df)
    holed = [c for c in df.columns if c in numeric and nulls[c] > 0]
    if mode == "all_missing_numeric":
        return sorted(holed)
    return sorted(holed, key=lambda c: -nulls[c])[:1]


def prepare_pair(
    full: DataFrame, holed: DataFrame, drop: Sequence[str] = (), numeric_only: bool = False
) -> tuple[DataFrame, DataFrame]:
    """Full and holed table with the same columns, without ids and labels."""
    full, holed = full.drop(*drop), holed.drop(*drop)
    if numeric_only:
        keep = numeric_columns(full)
        full, holed = full.select(*keep), holed.select(*[c for c in keep if c in holed.columns])
    if full.columns != holed.columns:
        raise ValueError(f"Columns differ: {full.columns} and {holed.columns}.")
    return full, holed


def target_summary(df: DataFrame, target: str) -> dict[str, float]:
    """min, q1, median, q3, max and mean of the observed values; {} when there are none."""
    value = df.select(_value(df, target).alias("v"))
    row = value.agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.avg("v").alias("m")).first()
    if row["lo"] is None:
        return {}
    q1, median, q3 = exact_quantiles(value, ["v"], [0.25, 0.5, 0.75])["v"]
    return {"min": row["lo"], "q1": q1, "median": median, "q3": q3,
            "max": row["hi"], "mean": row["m"]}


def _value(df: DataFrame, column: str) -> Column:
    if isinstance(df.schema[column].dataType, T.StringType):
        return text_number(F.col(column))
    return number(column)


def numeric_scales(df: DataFrame, columns: Sequence[str]) -> dict[str, float]:
    """Typical distance per column: IQR, else sample deviation, else |median|, else 1."""
    quantiles = exact_quantiles(df, columns, [0.25, 0.5, 0.75])
    known = [c for c in columns if quantiles[c] is not None]
    if not known:
        return {}
    spread = df.agg(*[
        F.coalesce(F.stddev_samp(number(c)), F.lit(0.0)).alias(f"s{i}")
        for i, c in enumerate(known)]).first()
    scales = {}
    for i, c in enumerate(known):
        q1, median, q3 = quantiles[c]
        options = (q3 - q1, spread[f"s{i}"], abs(median), 1.0)
        scales[c] = next(x for x in options if x > 0)
    return scales


def split_observed(
    df: DataFrame, target: str, limit: int | None = None, order: Sequence[str] = (),
    pick: Column | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(rows with a target, rows to fill), the latter optionally picked or cut to a head."""
    observed = df.where(F.col(target).isNotNull())
    open_rows = df.where(F.col(target).isNull() if pick is None else pick)
    if limit is not None:
        if limit < 1:
            raise ValueError("The limit must be at least 1.")
        open_rows = open_rows.orderBy(*order).limit(limit)
    return observed, open_rows
