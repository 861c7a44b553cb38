"""Controlled holes: completely at random, dependent on a column, on the value itself."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import hex_unit, row_hex, row_unit
from ..session import cut_lineage
from .order import number, smallest, with_rank_in_place


def _punch(df: DataFrame, column: str, hole: Column) -> DataFrame:
    return df.withColumn(column, F.when(hole, F.lit(None)).otherwise(F.col(column)))


def mcar(
    df: DataFrame, fraction: float, keys: Sequence[str], seed: int = 42,
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """Every cell of `columns` (default: all but the keys) is emptied with the same probability."""
    chosen = [c for c in df.columns if c not in keys] if columns is None else list(columns)
    return df.select(*[
        F.when(row_unit(seed, keys, c) >= F.lit(fraction), F.col(c)).alias(c)
        if c in chosen else F.col(c)
        for c in df.columns])


def mcar_excluding(
    df: DataFrame, fraction: float, exclude: Sequence[str], keys: Sequence[str], seed: int = 42
) -> DataFrame:
    """As `mcar`, leaving ids, labels and the row key untouched."""
    eligible = [c for c in df.columns if c not in exclude and c not in keys]
    return mcar(df, fraction, keys, seed, eligible) if eligible else df


def mcar_column(
    df: DataFrame, fraction: float, column: str, keys: Sequence[str], seed: int = 42
) -> DataFrame:
    """Exactly `int(fraction * rows)` holes in one column, uniform over its filled rows."""
    row = df.agg(F.count(F.lit(1)).alias("n"), F.count(column).alias("filled")).first()
    k = int(fraction * row["n"])
    if k > row["filled"]:
        raise ValueError(f"Cannot empty {k} of {row['filled']} filled cells in '{column}'.")
    digits = row_hex(seed, keys, column)
    staged = df.withColumn("_digits", digits)
    open_cell = F.col(column).isNotNull()
    staged = staged.withColumn("_u", F.when(open_cell, hex_unit(F.col("_digits"), 1)))
    staged = staged.withColumn("_t", hex_unit(F.col("_digits"), 14))
    hole = smallest(staged.select("_u", "_t"), ["_u", "_t"], k, (row["filled"], 0.0, 1.0))
    return _punch(staged, column, hole).select(*df.columns)


def with_ranked_draw(
    df: DataFrame, driver: str, target: str, keys: Sequence[str], seed: int, n_open: int, name: str
) -> DataFrame:
    """Add the number by which holes are drawn one after another, with probability proportional to the driver's mid-rank.

    The k smallest of -ln(u)/weight are such a draw (Efraimidis and Spirakis 2006). Null where there is nothing to draw;
    `n_open` is the number of rows where `open_cell` holds.
    """
    staged = df.withColumn("_driver", F.when(open_cell(driver, target), number(driver))).withColumn(
        "_digits", row_hex(seed, keys, target))
    ranked = with_rank_in_place(staged, "_driver", "_digits", n_open, "_w")
    draw = -F.log(hex_unit(F.col("_digits"), 1)) / F.col("_w")
    return ranked.select(*df.columns, draw.alias(name))


def open_cell(driver: str, target: str) -> Column:
    return F.col(target).isNotNull() & number(driver).isNotNull()


def tie_breaker(target: str, keys: Sequence[str], seed: int) -> Column:
    return hex_unit(row_hex(seed, keys, target), 14)


def _ranked_holes(
    df: DataFrame, driver: str, target: str, fraction: float, keys: Sequence[str], seed: int
) -> DataFrame:
    row = df.agg(F.count(F.lit(1)).alias("n"), F.count_if(open_cell(driver, target)).alias("open")).first()
    k = min(int(round(fraction * row["n"])), row["open"])
    if k == 0:
        return df
    draw = with_ranked_draw(df, driver, target, keys, seed, row["open"], "_key")
    # Stored in its order once: the passes for the threshold and the result read it.
    draw = cut_lineage(draw.withColumn("_t", tie_breaker(target, keys, seed)))
    return _punch(draw, target, smallest(draw, ["_key", "_t"], k)).select(*df.columns)


def mar(
    df: DataFrame, driver: str, target: str, fraction: float, keys: Sequence[str], seed: int = 42
) -> DataFrame:
    """Holes in `target`, likelier where `driver` is large."""
    if driver == target:
        raise ValueError("The driver and the target must be different columns.")
    return _ranked_holes(df, driver, target, fraction, keys, seed)


def mnar(
    df: DataFrame, target: str, fraction: float, keys: Sequence[str], seed: int = 42
) -> DataFrame:
    """Holes in `target`, likelier where the value itself is large."""
    return _ranked_holes(df, target, target, fraction, keys, seed)
