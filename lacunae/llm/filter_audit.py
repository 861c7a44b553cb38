"""What each of several filters removes, in every order, and its Shapley share.

Whether a filter removes a document depends only on the set of filters that ran before it. Those sets are the
states of a lattice (2**5 for five filters), and running one more filter is an edge. A document is counted once,
by the set of filters it fails: an edge removes the documents that fail its filter and none of the state it starts
from. So 32 counts per part give the weights of all 80 edges, and the 120 orders only read them.

Path counts run forward (orders that reach a state) and backward (orders that leave it to the end). Their
product is the number of orders that use an edge; removals weighted with it are the Shapley sums.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SPACES = r"[\x20\x09-\x0D]+"
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


# ---- lattice ----

class Lattice:
    """States and edges of `n` filters: a state is the bit set of those that ran, an edge runs one more."""

    def __init__(self, n: int):
        self.n = n
        self.states = np.arange(1 << n)
        self.before, self.filter = np.nonzero(~self.states[:, None] >> np.arange(n) & 1)
        self.bit = 1 << self.filter
        self.after = self.before | self.bit
        self.place = np.full((1 << n, n), -1)
        self.place[self.before, self.filter] = np.arange(len(self.before))
        self.uses = self._path_counts()
        # Which sets of failed filters are removed at an edge, and which are alive in a state.
        self.hits = ((self.states & self.before[:, None]) == 0) & ((self.states & self.bit[:, None]) != 0)
        self.lives = (self.states & self.states[:, None]) == 0
        self.orders = list(itertools.permutations(range(n)))
        self.steps = np.array([[self.place[sum(1 << f for f in order[:k]), f] for k, f in enumerate(order)]
                               for order in self.orders])

    def _path_counts(self) -> np.ndarray:
        """Orders that use each edge: those that reach its start times those that leave its end."""
        forward, backward = np.zeros(1 << self.n, np.int64), np.zeros(1 << self.n, np.int64)
        forward[0] = backward[-1] = 1
        for before, after in zip(self.before, self.after):  # by rising state
            forward[after] += forward[before]
        for before, after in zip(self.before[::-1], self.after[::-1]):
            backward[before] += backward[after]
        return forward[self.before] * backward[self.after]

    def shapley(self, removed: np.ndarray) -> np.ndarray:
        """Removals of every filter, summed over all orders."""
        sums = np.zeros(self.n, np.int64)
        np.add.at(sums, self.filter, removed * self.uses)
        return sums


def order_rows(states: DataFrame, names: str, part: str = "part") -> DataFrame:
    """A row per part, order and step from (part, mask, n, good, toxic); at most 2**filters rows a part."""
    by_part = states.groupBy(part).agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("states"))
    lattice = Lattice(len(names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = lattice.place[0]  # the edges from the state in which nothing ran
        last = lattice.place[lattice.states[-1] & ~(1 << np.arange(lattice.n)), np.arange(lattice.n)]
        edges = lattice.steps.ravel()
        which = lattice.filter[edges]
        labels = pa.array(["".join(names[f] for f in order) for order in lattice.orders])
        labels = labels.take(pa.array(np.arange(len(edges)) // lattice.n))
        steps = pa.array(np.tile(np.arange(1, lattice.n + 1, dtype=np.int32), len(lattice.orders)))
        for batch in batches:
            for row, found in enumerate(batch.column(1).to_pylist()):
                counts = np.zeros((3, len(lattice.states)), np.int64)
                for state in found:
                    counts[:, state["mask"]] = state["n"], state["good"], state["toxic"]
                removed, good, toxic = counts @ lattice.hits.T.astype(np.int64)
                alive = lattice.lives.astype(np.int64) @ counts[0]
                columns = (alive[lattice.after[edges]], removed[edges], removed[first][which] - removed[edges],
                           removed[last][which], good[edges], toxic[edges], lattice.shapley(removed)[which])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array([row] * len(edges))), labels, steps, *map(pa.array, columns)],
                    [part, "filter_order", "step", *COUNTS])

    kind = states.schema[part].dataType.simpleString()
    return by_part.mapInArrow(run, f"`{part}` {kind}, filter_order string, step int, " + ", ".join(
        f"{c} long" for c in COUNTS))


# ---- the filters ----

def failures(text: Column) -> dict[str, Column]:
    """Conditions under which a text fails; `repeated` is decided over the table."""
    words = F.array_remove(F.split(text, SPACES), "")
    n_words, n_distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.regexp_count(text, F.lit("[A-Z]"))
    return {
        "A": n_words < 50,
        "B": F.lit(100).cast("long") * n_distinct < F.lit(65) * n_words,
        "C": F.lit(100).cast("long") * capitals > F.lit(5) * F.length(text),
        "D": text.rlike(r"[#$%&*|]"),
        "E": F.lit(False),  # decided over the table
    }


def failed_sets(docs: DataFrame, labels: DataFrame | None, filters: Mapping[str, Column],
                id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(part, mask, n, good, toxic): documents by the set of filters they fail.

    Texts are met by digest. Equal texts of one part and label are counted together before anything is dealt
    by the digest, with the least id and the number of rows that bear it, so a text that fills a third of the
    table is a few rows per part.
    """
    names = list(filters)
    bits = F.lit(0)
    for i, name in enumerate(names):
        if name != "E":
            bits = bits + F.when(filters[name], F.lit(1 << i)).otherwise(F.lit(0))
    rows = docs.select(
        F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
        F.coalesce(F.col(text_col), F.lit("")).alias("body"))
    rows = rows.select("id", "part", F.unhex(F.sha2("body", 256)).alias("digest"), bits.alias("mask"))
    each = rows.groupBy("id", "part", "digest", "mask").agg(F.count("*").alias("n"))
    if labels is None:
        marked = each.select("*", F.lit(0).alias("good"), F.lit(0).alias("toxic"))
    else:
        known = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id")).agg(
            F.max((F.col("quality") == 1).cast("int")).alias("good"),
            F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
        marked = each.join(known, "id", "left").fillna(0, ["good", "toxic"])
    repeated = names.index("E") if "E" in names else None
    if repeated is None:
        cases = marked
    else:
        alike = marked.groupBy("digest", "part", "mask", "good", "toxic").agg(
            F.sum("n").alias("n"), F.min("id").alias("least"),
            # Rows with the least id; rows without an id are never repeats of another.
            F.sum(F.when(F.col("id").isNull(), F.col("n"))).alias("free"),
            F.min_by("n", F.col("id")).alias("n_least"))
        # At most a row per part, label and digest, so no group is large.
        alike = alike.withColumn("first", F.min("least").over(Window.partitionBy("digest")))
        kept = F.coalesce("free", F.lit(0)) + F.when(
            F.col("least") == F.col("first"), F.col("n_least")).otherwise(F.lit(0))
        cases = alike.select("part", "good", "toxic", F.explode(F.array(
            F.struct(F.col("mask"), kept.alias("n")),
            F.struct((F.col("mask") + F.lit(1 << repeated)).alias("mask"), (F.col("n") - kept).alias("n"))
        )).alias("case")).select("part", "good", "toxic", "case.*").where("n > 0")
    return cases.groupBy("part", "mask").agg(
        F.sum("n").cast("long").alias("n"), F.sum(F.col("n") * F.col("good")).cast("long").alias("good"),
        F.sum(F.col("n") * F.col("toxic")).cast("long").alias("toxic"))


def audit_filters(docs: DataFrame, labels: DataFrame | None = None,
                  filters: Mapping[str, Column] | None = None, id_col: str = "doc_id",
                  text_col: str = "text", part_col: str = "source") -> DataFrame:
    """A row per part, order of the filters and step: what the step keeps and removes, and why.

    `filters` maps one-letter names to failure conditions over the column `body` (the text, null as empty); "E" is
    the repeat of a text whose id is smaller, table-wide, and its condition is ignored. Columns: part, filter_order,
    step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley (removals of the filter summed over
    all orders).

    * Null text is empty; null parts and empty ones are one part, "". A null id is no smaller id and has none:
      such rows never fail E. Rows that repeat an id and a text don't make each other fail E, and count
      each. Labels that repeat an id count as 1 if any of them is; null labels are 0.
    * Every part of the table gets all rows, with zeros. An empty table gives an empty result.
    * Only the named columns are read, so other columns may have any name.
    """
    filters = filters or failures(F.col("body"))
    names = "".join(filters)
    states = failed_sets(docs, labels, filters, id_col, text_col, part_col)
    return order_rows(states, names)
