"""From hash buckets to connected components, with DataFrame operations only.

`components` is a distributed union-find by large and small stars. `link_buckets` tests every pair of
a bucket whose ends are not connected anyway: first all members against the one with most neighbours, later a
fixed number of members of the smallest components against all others, and the rest at once when that is no
more than `pairs_per_row` pairs a row. Members of a component are never paired, so a bucket of many similar
members costs a test per member, not per pair. Before a pair leaves the join, short sketches rule out
what is far from similar.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, settled


def _fingerprint(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(edges: DataFrame, name: str = "edges") -> DataFrame:
    """(node, component) for all nodes of `edges` (a, b) but the smallest of each component.

    Nodes of any ordered type; nulls and loops are left out, repeated edges do no harm.
    """
    links = edges.where("a <> b").select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    links = settled(links, name)
    state = _fingerprint(links)
    while state[0]:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        large = both.join(least, "u").where("v > u").select(
            F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(
            F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(least.withColumnRenamed("m", "v")).distinct()
        old, links = links, settled(small, name)
        discard(old)
        before, state = state, _fingerprint(links)
        if state == before:
            break
    return links.select(F.col("u").alias("node"), F.col("v").alias("component"))


def differing(words: int) -> Column:
    """How many of the 32 two-bit values in each 64-bit word differ between sketches s* and q*."""
    total = F.lit(0)
    for i in range(words):
        x = F.col(f"s{i}").bitwiseXOR(F.col(f"q{i}"))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        total = total + F.bit_count(x.bitwiseAND(F.lit(0x5555555555555555)))
    return total


def parity_words(h: Column, words: int) -> list[Column]:
    """Per group: the parities of how many distinct hashes fall on each of 64 * `words` places, 64 to a word."""
    place = F.shiftrightunsigned(h, 6).bitwiseAND(F.lit(words - 1))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), h.bitwiseAND(F.lit(63)).cast("int"))
    return [F.coalesce(F.bit_xor(F.when(place == i, bit)), F.lit(0).cast("long")) for i in range(words)]


def odd_places(words: int) -> Column:
    """In how many places the parities x* and y* of two sets differ: at most the elements that only one of them has."""
    total = F.lit(0)
    for i in range(words):
        total = total + F.bit_count(F.col(f"x{i}").bitwiseXOR(F.col(f"y{i}")))
    return total


def most_differing(values: int, similarity: float) -> int:
    """Values that may differ in sketches of a pair at `similarity`: 4 standard deviations more than its mean."""
    mean = 0.75 * (1 - similarity)
    return math.ceil(values * mean + 4 * math.sqrt(values * mean * (1 - mean)))


def link_buckets(buckets: DataFrame, verify: Callable[[DataFrame], DataFrame],
                 sketches: DataFrame | None = None, words: int = 0, most: int = 0,
                 percent: int = 0, pairs_per_row: int = 1024,
                 parities: Callable[[DataFrame], DataFrame] | None = None, parity: int = 0) -> DataFrame:
    """Components of the links that `verify` confirms among pairs (a, b) in a bucket.

    `buckets` has rows (bucket, id). Pairs are passed to `verify` without repeats. With `sketches`
    (id, size of its set, sketch: `words` 64-bit words of 32 two-bit values), only pairs that differ in
    `most` values at most, and whose smaller set has `percent` of the larger, are passed on.

    `parities` makes (id, size, x0, x1, ...) of ids: the sizes of their sets and `parity` words of `parity_words`. They
    are made for what the lead round leaves only, so they may be long. Sets at a similarity of `percent` have at
    most (100 - percent) / (100 + percent) of both sizes in elements of one set only, so this rule loses no link.
    """
    sizes = buckets.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    members = settled(buckets.distinct().join(sizes, "bucket"), "buckets")
    # The member that shares most places with others is the likeliest centre of a group of copies.
    weights = members.groupBy("id").agg(F.sum("n").alias("weight"))
    leads = members.join(weights, "id").groupBy("bucket").agg(
        F.max_by("id", F.struct("weight", "id")).alias("lead"))
    members = settled(members.join(leads, "bucket").select("bucket", "id", "lead"), "members")
    members = members.where("id <> lead")
    pairs = members.select(F.least("id", "lead").alias("a"), F.greatest("id", "lead").alias("b"))
    pairs = settled(pairs.distinct(), "pairs")
    links = settled(verify(pairs), "links")
    found = components(links)
    # From here on the buckets that share members are one, so that no pair is met once per bucket.
    both = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
    members = both.join(components(pairs).withColumnRenamed("node", "id"), "id", "left").select(
        "id", F.coalesce("component", "id").alias("bucket"))
    left = exact = None
    while True:
        known = found.select(F.col("node").alias("id"), "component")
        placed = members.join(known, "id", "left").select(
            "bucket", "id", F.coalesce("component", "id").alias("part"))
        parts = placed.groupBy("bucket", "part").agg(F.count("*").alias("n"))
        mixed = parts.groupBy("bucket").agg(
            F.sum("n").alias("rows"), F.sum(F.col("n") * F.col("n")).alias("within"),
            F.max_by("part", F.struct("n", "part")).alias("main"), F.count("*").alias("parts"))
        mixed = settled(mixed.where("parts > 1"), "mixed")
        cross, rows = mixed.agg(
            F.sum((F.col("rows") * F.col("rows") - F.col("within")) / 2), F.sum("rows")).first()
        if not rows:
            return found
        last_left, left = left, placed.join(mixed.select("bucket", "main"), "bucket").join(parts, ["bucket", "part"])
        if parities is not None and exact is None:
            exact = settled(parities(left.select("id")), "parities")
        if sketches is not None:
            left = left.join(sketches.select("id", *([] if parities else ["size"]), *[
                F.col("sketch")[i].alias(f"s{i}") for i in range(words)]), "id")
        if exact is not None:
            left = left.join(exact, "id")
        left, old = settled(left, "left"), last_left
        if old is not None:
            discard(old)
        last = cross <= pairs_per_row * rows
        if last:
            # One end lies outside the main part, so a large part is never paired with itself.
            side = left.where("part <> main")
        else:
            order = Window.partitionBy("bucket").orderBy("n", "part", "id")
            side = left.withColumn("place", F.row_number().over(order)).where(
                F.col("place") <= max(1, pairs_per_row))
        side = side.select(F.col("bucket").alias("other"), F.col("id").alias("x"), F.col("part").alias("p"),
                           *([F.col("size").alias("other_size")] if words else []),
                           *[F.col(f"s{i}").alias(f"q{i}") for i in range(words)],
                           *[F.col(f"x{i}").alias(f"y{i}") for i in range(parity)])
        meet = (F.col("bucket") == F.col("other")) & (F.col("part") != F.col("p"))
        if last:
            meet = meet & ((F.col("part") == F.col("main")) | (F.col("id") < F.col("x")))
        if sketches is not None:
            meet = meet & (F.least("size", "other_size") * 100 >= F.greatest("size", "other_size") * percent)
            meet = meet & (differing(words) <= most)
        if parities is not None:
            meet = meet & (odd_places(parity) * (100 + percent) <= (F.col("size") + F.col("other_size")) * (100 - percent))
        pairs = left.join(side, meet).select(F.least("id", "x").alias("a"), F.greatest("id", "x").alias("b"))
        links = settled(links.unionByName(verify(pairs.distinct())), "links")
        found = components(links)
        if last:
            return found
        gone = side.select(F.col("other").alias("bucket"), F.col("x").alias("id"))
        members = left.select("bucket", "id").join(gone, ["bucket", "id"], "left_anti")
