"""Folds, stratified bins and prompt context."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import row_unit
from .order import exact_quantiles, number, running_totals, smallest, with_position


def contiguous_folds(
    df: DataFrame, order: Sequence[str], k: int, name: str = "fold_id"
) -> DataFrame:
    """1-based folds of consecutive rows; the first n % k folds get one row more."""
    if k < 1:
        raise ValueError("The number of folds must be at least 1.")
    n = df.count()
    k = max(1, min(k, n))
    base, extra = divmod(n, k)
    placed = with_position(df, order, "_position")
    head = extra * (base + 1)
    p = F.col("_position")
    fold = F.when(p < head, F.floor(p / F.lit(base + 1))).otherwise(
        F.lit(extra) + F.floor((p - head) / F.lit(max(base, 1))))
    return placed.withColumn(name, (fold + 1).cast("int")).drop("_position")


def _bin_sizes(n: int, q: int) -> list[int]:
    """Rows per quantile bin of the ranks 1..n."""
    ends = [(n - 1) * (i + 1) // q for i in range(q)]
    return [e - s for s, e in zip([-1, *ends], ends)]


def choose_bins(n: int, distinct: int, n_splits: int, requested: int) -> int:
    """Most bins such that each holds a row for every fold; 0 when two are too many."""
    most = min(n // n_splits, distinct, max(requested, 2))
    return next((q for q in range(most, 1, -1) if min(_bin_sizes(n, q)) >= n_splits), 0)


def stratify_bins(
    df: DataFrame, value: str, order: Sequence[str], n_splits: int, requested: int = 10,
    name: str = "bin",
) -> tuple[DataFrame, int]:
    """Quantile bins over the ranks of `value`, ties in the order of the key."""
    n = df.count()
    enough = max(requested, 2)
    distinct = df.select(value).where(F.col(value).isNotNull()).distinct().limit(enough).count()
    q = choose_bins(n, distinct, n_splits, requested)
    if q == 0:
        raise ValueError("Too few rows or values to stratify; use fewer folds.")
    placed = with_position(df, [value, *order], "_position")
    # Whole-number ceiling of position * q / (n - 1).
    upper = F.floor((F.col("_position") * q + (n - 2)) / F.lit(n - 1))
    return placed.withColumn(
        name, F.greatest(F.lit(0), upper - 1).cast("int")).drop("_position"), q


def stratified_kfold(
    df: DataFrame, value: str, order: Sequence[str], k: int, seed: int = 42,
    requested: int = 10, name: str = "fold_id",
) -> DataFrame:
    """1-based folds of equal size within each bin, in hash order."""
    if k < 2:
        raise ValueError("Cross-validation needs at least two folds.")
    binned, _ = stratify_bins(df, value, order, k, requested)
    shuffled = binned.withColumn("_u", row_unit(seed, order, "fold"))
    numbered = running_totals(
        shuffled, ["bin"], ["_u", *order], {"_place": F.lit(1).cast("long")})
    return numbered.withColumn(
        name, ((F.col("_place") - 1) % k + 1).cast("int")).drop("_place", "_u")


def fold_reveal(target: str, truth: str, fold: str, chosen: int) -> Column:
    """Target where only the holes of one fold stay open; the others show the truth."""
    stays = F.col(target).isNull() & (F.col(fold) == F.lit(chosen))
    return F.when(~F.coalesce(stays, F.lit(False)), F.coalesce(F.col(target), F.col(truth)))


def fold_train_median(df: DataFrame, value: str, fold: str, k: int) -> DataFrame:
    """(fold, train_median): median of the rows outside each fold, all folds in one pass."""
    names = {f"_{f}": f for f in range(1, k + 1)}
    wide = df.select(*[
        F.when(F.col(fold) != F.lit(f), number(value)).alias(n) for n, f in names.items()])
    medians = exact_quantiles(wide, list(names), [0.5])
    rows = [(f, medians[n] and float(medians[n][0])) for n, f in names.items()]
    return df.sparkSession.createDataFrame(rows, f"{fold} int, train_median double")


def nearest_required(
    df: DataFrame, position: str, required: Column, name: str = "distance", **options
) -> DataFrame:
    """Distance of every position to the nearest required one."""
    flagged = df.withColumns({
        "_up": F.when(required, F.col(position)), "_back": -F.col(position)})
    before = running_totals(
        flagged, [], [position], {"_before": F.col("_up")}, how="max", **options)
    after = running_totals(
        before, [], ["_back"], {"_after": -F.col("_up")}, how="max", **options)
    return after.withColumn(name, F.least(
        F.col(position) - F.col("_before"), -F.col("_after") - F.col(position))).drop(
        "_up", "_back", "_before", "_after")


def compact_context(
    df: DataFrame, target: str, required: str, budget: int | None, position: str = "position"
) -> DataFrame:
    """Rows for a prompt: all required ones first, then observed ones by nearness.

    `required` is a boolean column. Adds context_position. With a budget of all
    rows, every row is kept and the others follow in their own order.
    """
    row = df.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(required)).alias("m")).first()
    n, m = row["n"], row["m"]
    if n == 0 or m == 0:
        raise ValueError("There must be rows and at least one required row.")
    budget = n if budget is None else min(max(int(budget), m), n)
    if budget >= n:
        staged = df.withColumn("_nearness", F.when(F.col(required), -1).otherwise(0))
    else:
        near = nearest_required(df, position, F.col(required))
        open_row = ~F.col(required) & F.col(target).isNotNull()
        near = near.withColumn("_nearness", F.when(open_row, F.col("distance")))
        take = smallest(near, ["_nearness", position], budget - m)
        near = near.where(F.col(required) | take)
        staged = near.withColumn(
            "_nearness", F.when(F.col(required), -1).otherwise(F.col("_nearness"))).drop("distance")
    return with_position(
        staged, ["_nearness", position], "context_position").drop("_nearness")




def sample_records(
    df: DataFrame, n: int, keys: Sequence[str], seed: int = 42
) -> DataFrame:
    """n rows in seeded random order; asking for more than there are fails."""
    size = df.count()
    if n > size:
        raise ValueError(f"Asked for {n} of {size} records.")
    staged = df.withColumn("_u", row_unit(seed, keys, "sample"))
    chosen = staged.where(smallest(staged.select("_u"), ["_u"], n, (size, 0.0, 1.0)))
    return with_position(chosen, ["_u", *keys], "sample_position").drop("_u")
