"""Distributed order: exact order statistics, positions, running totals, ranks.

An ORDER BY without partition, the built-in exact percentile and a window over
the whole table each end in one task. The helpers here keep every step spread
out: histograms narrow a value range until the rest is small, and rows are put
into ordered buckets of bounded size whose totals are small enough to sum up on
the driver.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

HISTOGRAM_BUCKETS = 4096
COLLECT_LIMIT = 20_000
SMALL_COLUMN = 1_000_000
BUCKET_ROWS = 250_000
MAX_BUCKETS = 20_000
SAMPLE_PER_CUT = 40
BROADCAST_ROWS = 100_000


def number(col: Column | str) -> Column:
    """Column as double, with NaN as null."""
    c = (F.col(col) if isinstance(col, str) else col).cast("double")
    return F.nanvl(c, F.lit(None).cast("double"))


@dataclass(frozen=True)
class Pick:
    """Value at a rank, with the number of rows below it and equal to it."""

    value: float
    below: int
    equal: int


@dataclass
class _Range:
    column: str
    low: float
    high: float
    below: int
    inside: int
    ranks: set[int] = field(default_factory=set)


def column_ranges(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[int, float, float]]:
    """(non-null count, min, max) of each column in one pass."""
    aggs = []
    for i, c in enumerate(columns):
        v = number(c)
        aggs += [F.count(v).alias(f"n{i}"), F.min(v).alias(f"lo{i}"), F.max(v).alias(f"hi{i}")]
    row = df.agg(*aggs).first()
    return {c: (row[f"n{i}"], row[f"lo{i}"], row[f"hi{i}"]) for i, c in enumerate(columns)}


def pick_ranks(
    df: DataFrame,
    wanted: Mapping[str, Sequence[int]],
    ranges: Mapping[str, tuple[int, float, float]] | None = None,
    collect_limit: int = COLLECT_LIMIT,
    buckets: int = HISTOGRAM_BUCKETS,
) -> dict[str, dict[int, Pick]]:
    """Exact values at 0-based ranks of the sorted non-null values of each column.

    Each pass cuts the range that holds a wanted rank by `buckets`; only bucket
    counts reach the driver. The last pass counts the few values left.
    """
    ranges = ranges or column_ranges(df, list(wanted))
    found: dict[str, dict[int, Pick]] = {c: {} for c in wanted}
    todo = [
        _Range(c, ranges[c][1], ranges[c][2], 0, ranges[c][0], set(ranks))
        for c, ranks in wanted.items()
        if ranges[c][0] and ranks
    ]
    while todo:
        rest = []
        for r in todo:
            if r.low == r.high:
                for rank in r.ranks:
                    found[r.column][rank] = Pick(r.low, r.below, r.inside)
            else:
                rest.append(r)
        wide = [r for r in rest if r.inside > collect_limit]
        narrow = [r for r in rest if r.inside <= collect_limit]
        if narrow:
            for r, values in zip(narrow, _count_cells(df, narrow, None)):
                _walk(r, values, lambda rank, low, high, below, inside, column=r.column: (
                    found[column].__setitem__(rank, Pick(low, below, inside))))
        todo = []
        if wide:
            for r, cells in zip(wide, _count_cells(df, wide, buckets)):
                children: dict[tuple[float, float], _Range] = {}

                def keep(rank, low, high, below, inside, column=r.column, children=children):
                    child = children.setdefault(
                        (low, high), _Range(column, low, high, below, inside))
                    child.ranks.add(rank)

                _walk(r, cells, keep)
                todo += children.values()
    return found


def _count_cells(df: DataFrame, ranges: list[_Range], buckets: int | None):
    """Per range: sorted (low, high, count) of its buckets, or of its values.

    Rows outside a range become one null group instead of being filtered: a filter
    would be pushed down and compute a costly key once more.
    """
    columns = list(dict.fromkeys(r.column for r in ranges))
    values = df.select(*[number(c).alias(c) for c in columns])
    entries = []
    for i, r in enumerate(ranges):
        v = F.col(r.column)
        cell = F.lit(0)
        if buckets is not None and math.isinf(r.high - r.low) and (
                math.isinf(r.low) or math.isinf(r.high)):
            cell = F.when(v == F.lit(math.inf), 2).when(v == F.lit(-math.inf), 0).otherwise(1)
        elif buckets is not None:
            # Halves, so that the width of the widest range is still a number.
            share = (v / 2 - F.lit(r.low / 2)) / F.lit(r.high / 2 - r.low / 2)
            cell = F.least(F.floor(share * buckets), F.lit(buckets - 1))
        inside = v.between(F.lit(r.low), F.lit(r.high))
        entries.append(F.when(inside, F.struct(
            F.lit(i).alias("r"), cell.cast("int").alias("cell"), v.alias("v"))))
    if len(entries) == 1:
        cells = values.select(entries[0].alias("e"))
    else:
        cells = values.select(F.explode(F.array_compact(F.array(*entries))).alias("e"))
    cells = cells.select("e.r", "e.cell", "e.v")
    group = ["r", "v"] if buckets is None else ["r", "cell"]
    counted = cells.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
    out: list[list[tuple[float, float, int]]] = [[] for _ in ranges]
    for row in counted.collect():
        if row["r"] is not None:
            out[row["r"]].append((row["low"], row["high"], row["n"]))
    return [sorted(cells) for cells in out]


def _walk(r: _Range, cells, emit) -> None:
    below = r.below
    ranks = sorted(r.ranks)
    i = 0
    for low, high, n in cells:
        while i < len(ranks) and ranks[i] < below + n:
            emit(ranks[i], low, high, below, n)
            i += 1
        below += n


def exact_quantiles(
    df: DataFrame,
    columns: Sequence[str],
    probs: Sequence[float],
    small: int = SMALL_COLUMN,
) -> dict[str, list[float] | None]:
    """Exact quantiles with linear interpolation; None for an all-null column.

    A column of at most `small` values fits in one aggregation buffer and uses
    the built-in percentile; a larger one is narrowed down by histograms.
    """
    if not columns:
        return {}
    ranges = column_ranges(df, columns)
    out: dict[str, list[float] | None] = {c: None for c in columns}
    direct = [c for c in columns if 0 < ranges[c][0] <= small]
    large = [c for c in columns if ranges[c][0] > small]
    if direct:
        row = df.agg(*[
            F.percentile(number(c), F.array(*[F.lit(float(p)) for p in probs])).alias(f"q{i}")
            for i, c in enumerate(direct)]).first()
        out.update({c: list(row[f"q{i}"]) for i, c in enumerate(direct)})
    if large:
        spots = {c: [p * (ranges[c][0] - 1) for p in probs] for c in large}
        wanted = {c: {f(s) for s in spots[c] for f in (math.floor, math.ceil)} for c in large}
        picks = pick_ranks(df, wanted, {c: ranges[c] for c in large})
        for c in large:
            values = []
            for spot in spots[c]:
                low, high = math.floor(spot), math.ceil(spot)
                a, b = picks[c][low].value, picks[c][high].value
                values.append(a if low == high else (high - spot) * a + (spot - low) * b)
            out[c] = values
    return out


def smallest(
    df: DataFrame, keys: Sequence[str], k: int, known: tuple[int, float, float] | None = None
) -> Column:
    """Predicate on `df` that holds for exactly the k smallest rows by the key columns.

    Only literals come back, so the sample is a plain filter: no row is moved.
    `known` is (count, low, high) of the first key, when the caller has it.
    """
    first, *others = keys
    size = {first: known} if known else column_ranges(df, [first])
    if k <= 0:
        return F.lit(False)
    if k >= size[first][0]:
        return F.col(first).isNotNull()
    cut = pick_ranks(df, {first: [k - 1]}, size)[first][k - 1]
    value = F.col(first).cast("double")
    if k == cut.below + cut.equal or not others:
        return F.coalesce(value <= F.lit(cut.value), F.lit(False))
    tied = df.where(value == F.lit(cut.value))
    return F.coalesce(
        (value < F.lit(cut.value))
        | ((value == F.lit(cut.value)) & smallest(tied, others, k - cut.below)),
        F.lit(False))


def smallest_of_many(df: DataFrame, wanted: Mapping[str, Sequence[int]], tie: str) -> dict[tuple[str, int], Column]:
    """As `smallest` for several columns and sizes at once: (column, k) to a predicate. All share their passes."""
    ranges = column_ranges(df, list(wanted))
    inside = {c: [k - 1 for k in ks if 0 < k < ranges[c][0]] for c, ks in wanted.items()}
    picks = pick_ranks(df, {c: ranks for c, ranks in inside.items() if ranks}, ranges) if any(inside.values()) else {}
    out = {}
    for c, ks in wanted.items():
        value = F.col(c).cast("double")
        for k in ks:
            if k <= 0:
                out[c, k] = F.lit(False)
            elif k >= ranges[c][0]:
                out[c, k] = F.col(c).isNotNull()
            else:
                cut = picks[c][k - 1]
                hole = value <= F.lit(cut.value)
                if k < cut.below + cut.equal:
                    tied = df.where(value == F.lit(cut.value))
                    hole = (value < F.lit(cut.value)) | (
                        (value == F.lit(cut.value)) & smallest(tied, [tie], k - cut.below))
                out[c, k] = F.coalesce(hole, F.lit(False))
    return out


def order_buckets(df: DataFrame, by: Sequence[str], n: int, bucket_rows: int) -> DataFrame:
    """Add `_b`: bucket numbers that ascend with the order of `by`.

    Bounds come from a bounded sample of the first column. A value that
    fills several quantiles on its own is split further by the second column,
    so one hot value does not make one hot bucket.
    """
    parts = min(MAX_BUCKETS, math.ceil(n / bucket_rows))
    if parts <= 1:
        return df.withColumn("_b", F.lit(0).cast("long"))
    cuts = sampled_cuts(df, by[:2], n, parts)
    edges = sorted(set(cuts["q0"]))
    repeats = {i: cuts["q0"].count(e) for i, e in enumerate(edges) if cuts["q0"].count(e) > 1}
    out = _bucket(df, by[0], edges, "_i")
    width = parts + 2
    slot = F.lit(parts + 1)
    if repeats and len(by) > 1:
        out = _bucket(out, by[1], sorted(set(cuts["q1"])), "_k")
        table = F.create_map(*[F.lit(x) for pair in repeats.items() for x in pair])
        copies = F.element_at(table, F.col("_i").cast("int") - 1)
        edge = F.element_at(F.array(*[F.lit(e) for e in edges]), F.greatest(
            F.col("_i").cast("int"), F.lit(1)))
        hot = copies.isNotNull() & (F.col(by[0]).cast("double") == edge)
        slot = F.when(hot, F.floor(F.col("_k") * copies / F.lit(parts))).otherwise(slot)
    out = out.withColumn("_b", (F.col("_i") * width + slot).cast("long"))
    return out.drop("_i", "_k")


def sampled_cuts(df: DataFrame, columns: Sequence[str], n: int, parts: int) -> dict[str, list[float]]:
    """parts - 1 cuts per column from about SAMPLE_PER_CUT sampled rows a part, sorted on the driver.

    At most SAMPLE_PER_CUT * MAX_BUCKETS rows are collected, whatever the size of the table, and no
    task sees more than its own rows. Cuts only decide how even the buckets are.
    """
    share = min(1.0, 1.2 * SAMPLE_PER_CUT * parts / n)
    rows = df.select(*[F.col(c).cast("double").alias(f"q{i}") for i, c in enumerate(columns)]).sample(
        fraction=share, seed=1).collect()
    out = {}
    for i in range(len(columns)):
        values = sorted(r[i] for r in rows if r[i] is not None)
        out[f"q{i}"] = [values[(k * len(values)) // parts] for k in range(1, parts)] if values else []
    return out


def _bucket(df: DataFrame, column: str, edges: list[float], name: str) -> DataFrame:
    splits = [-math.inf, *edges, math.inf]
    staged = df.withColumn("_x", F.col(column).cast("double"))
    return Bucketizer(splits=splits, inputCol="_x", outputCol=name).transform(staged).drop("_x")


def with_position(
    df: DataFrame, by: Sequence[str], name: str = "position", bucket_rows: int = BUCKET_ROWS
) -> DataFrame:
    """0-based position of each row in the order of `by` (numeric, non-null, unique)."""
    n = df.count()
    ordered = Window.partitionBy("_b").orderBy(*by)
    bucketed = order_buckets(df, by, n, bucket_rows)
    if n <= bucket_rows:
        return bucketed.withColumn(
            name, (F.row_number().over(ordered) - 1).cast("long")).drop("_b")
    sizes = bucketed.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))
    # At most three times MAX_BUCKETS rows are left here.
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return (
        bucketed.join(F.broadcast(starts), "_b")
        .withColumn(name, (F.col("_before") + F.row_number().over(ordered) - 1).cast("long"))
        .drop("_b", "_before"))


def running_totals(
    df: DataFrame,
    within: Sequence[str],
    by: Sequence[str],
    amounts: Mapping[str, Column],
    bucket_rows: int = BUCKET_ROWS,
    how: str = "sum",
    n: int | None = None,
) -> DataFrame:
    """Inclusive running sums (or maxima) per group in the order of `by`, one column per amount.

    A group may hold any share of the rows: it is cut into ordered buckets, and
    what the earlier buckets add is joined to each bucket. `n` is the number of
    rows, when the caller knows it.
    """
    fold, join_up = _FOLDS[how]
    n = df.count() if n is None else n
    names = list(amounts)
    work = df.select("*", *[amounts[a].alias(f"_amount_{a}") for a in names])
    work = order_buckets(work, by, n, bucket_rows)
    running = (Window.partitionBy(*within, "_b").orderBy(*by)
               .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    inner = {a: fold(f"_amount_{a}").over(running) for a in names}
    if n <= bucket_rows:
        out = work.select("*", *[inner[a].alias(a) for a in names])
    else:
        totals = work.groupBy(*within, "_b").agg(*[
            fold(f"_amount_{a}").alias(f"_total_{a}") for a in names])
        before = (Window.partitionBy(*within).orderBy("_b")
                  .rowsBetween(Window.unboundedPreceding, -1))
        starts = totals.select(*within, "_b", *[
            fold(f"_total_{a}").over(before).alias(f"_before_{a}") for a in names])
        joined = (work.join(starts, [*within, "_b"]) if within
                  else work.join(F.broadcast(starts), "_b"))
        out = joined.select("*", *[
            join_up(F.col(f"_before_{a}"), inner[a]).alias(a) for a in names])
    return out.select(*df.columns, *names)


_FOLDS = {
    "sum": (F.sum, lambda a, b: F.coalesce(a + b, a, b)),
    "max": (F.max, F.greatest),
}


def average_ranks(
    df: DataFrame, column: str, bucket_rows: int = BUCKET_ROWS
) -> tuple[DataFrame, int, int]:
    """Distinct values with their mid-rank among all rows; how many values and rows there are.

    Equal rows are counted before anything is ordered, so a hot value costs one row.
    """
    values = df.select(number(column).alias("rank_value"))
    counts = (values.where(F.col("rank_value").isNotNull())
              .groupBy("rank_value").agg(F.count(F.lit(1)).alias("rank_count")))
    # About that many values: a long list is stored once and not counted again.
    if values.agg(F.approx_count_distinct("rank_value")).first()[0] > bucket_rows // 2:
        counts = cut_lineage(counts)
    size = counts.agg(F.count(F.lit(1)).alias("n"), F.sum("rank_count").alias("rows")).first()
    ranked = running_totals(
        counts, [], ["rank_value"], {"_upto": F.col("rank_count")}, bucket_rows, n=size["n"])
    rank = F.col("_upto") - F.col("rank_count") + (F.col("rank_count") + 1) / F.lit(2.0)
    ranked = ranked.select("rank_value", "rank_count", rank.cast("double").alias("rank"))
    return ranked, size["n"], size["rows"] or 0


def with_average_rank(
    df: DataFrame,
    column: str,
    name: str = "rank",
    bucket_rows: int = BUCKET_ROWS,
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Mid-rank of each row's value among the non-null values; null stays null."""
    ranks, distinct, total = average_ranks(df, column, bucket_rows)
    staged = df.withColumn("_v", number(column))
    plain = ranks.select(F.col("rank_value").alias("_v"), F.col("rank").alias(name))
    if distinct <= broadcast_rows:
        return staged.join(F.broadcast(plain), "_v", "left").drop("_v")
    # A value with more than 1/1000 of the rows is hot: at most 1000 of them, broadcast.
    hot = ranks.where(F.col("rank_count") > F.lit(total / 1000)).select(
        F.col("rank_value").alias("_v"), F.col("rank").alias("_hot_rank"))
    marked = staged.join(F.broadcast(hot), "_v", "left")
    ready = F.col("_v").isNull() | F.col("_hot_rank").isNotNull()
    easy = marked.where(ready).withColumn(name, F.col("_hot_rank"))
    rest = marked.where(~ready).join(plain, "_v")
    columns = [*df.columns, name]
    return easy.select(*columns).unionByName(rest.select(*columns))


def with_rank_in_place(
    df: DataFrame, column: str, spread: str, n: int, name: str = "rank", bucket_rows: int = BUCKET_ROWS
) -> DataFrame:
    """As `with_average_rank` for a column of `n` values, but the rows are moved once and joined to nothing.

    Rows go into ordered buckets; a rank is the number of rows in the buckets before, plus the place in its own. A
    value that fills buckets alone is counted instead of ordered, and its rows, like nulls, are dealt by a hash of
    the column `spread`.
    """
    parts = max(1, min(MAX_BUCKETS, math.ceil(n / bucket_rows)))
    value = number(column)
    staged = df.withColumn("_v", value)
    cuts = sampled_cuts(staged.where(F.col("_v").isNotNull()), ["_v"], max(n, 1), parts)["q0"] if parts > 1 else []
    edges = sorted(set(cuts))
    hot = [e for e in edges if cuts.count(e) > 1]
    staged = _bucket(staged, "_v", edges, "_i") if edges else staged.withColumn(
        "_i", F.when(F.col("_v").isNotNull(), F.lit(0.0)))
    is_hot = F.coalesce(F.col("_v").isin(hot), F.lit(False)) if hot else F.lit(False)
    staged = staged.withColumn("_hot", is_hot)
    sizes = {(r["_i"], r["_hot"]): r["count"] for r in staged.where(
        F.col("_v").isNotNull()).groupBy("_i", "_hot").count().collect()}
    # A bucket begins with its hot value, if it has one.
    starts, before = [], 0
    for i in sorted({i for i, _ in sizes}):
        first, rest = sizes.get((i, True), 0), sizes.get((i, False), 0)
        starts += [(i, True, float(before), first), (i, False, float(before + first), 0)]
        before += first + rest
    table = df.sparkSession.createDataFrame(starts, "_i double, _hot boolean, _before double, _equal long")
    away = F.col("_v").isNull() | F.col("_hot")
    bucket = F.when(away, -1.0 - F.pmod(F.xxhash64(spread), F.lit(parts))).otherwise(F.col("_i"))
    staged = staged.join(F.broadcast(table), ["_i", "_hot"], "left").withColumn("_b", bucket)
    here = Window.partitionBy("_b")
    place = F.rank().over(here.orderBy("_v")) - 1
    equal = F.count(F.lit(1)).over(Window.partitionBy("_b", "_v"))
    rank = F.col("_before") + F.when(F.col("_hot"), (F.col("_equal") + 1) / 2.0).otherwise(place + (equal + 1) / 2.0)
    return staged.withColumn(name, F.when(F.col("_v").isNotNull(), rank)).select(*df.columns, name)


def salted_join(
    rows: DataFrame, table: DataFrame, keys: Sequence[str], how: str = "inner", salts: int = 32
) -> DataFrame:
    """Join many rows to a table with one row per key, however often a key occurs in the rows.

    The table is repeated once per salt, so the rows of a hot key end up in `salts`
    tasks instead of one.
    """
    salt = F.pmod(F.xxhash64(*rows.columns), F.lit(salts)).cast("int")
    copies = F.explode(F.array(*[F.lit(i) for i in range(salts)]))
    left = rows.withColumn("_salt", salt)
    right = table.withColumn("_salt", copies)
    return left.join(right, [*keys, "_salt"], how).drop("_salt")
