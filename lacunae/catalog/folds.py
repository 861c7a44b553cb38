"""Folds and prompt context."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.hashing import row_unit
from ..operators import evaluate, folds, inject
from ..operators.order import with_position
from ..plans.benchmark import cross_validate
from .fixtures import LINE_KEYS, ORDER_KEYS, lines, orders, sql_holed_orders, sql_unit


def g1_contiguous_folds(spark, sf):
    return folds.contiguous_folds(orders(spark, sf).select("o_orderkey"), ORDER_KEYS, 7)


def g2_stratify_bins(spark, sf):
    rows = orders(spark, sf).select("o_orderkey", "o_totalprice")
    return folds.stratify_bins(rows, "o_totalprice", ORDER_KEYS, 5)[0]


def g2_stratify_bins_ties(spark, sf):
    rows = orders(spark, sf).select(
        "o_orderkey", (F.col("o_custkey") % 3).alias("kind"))
    return folds.stratify_bins(rows, "kind", ORDER_KEYS, 5)[0]


def g3_stratified_kfold(spark, sf):
    rows = orders(spark, sf).select("o_orderkey", "o_totalprice")
    return folds.stratified_kfold(rows, "o_totalprice", ORDER_KEYS, 5)


def _folded(spark, sf):
    full = orders(spark, sf).select("o_orderkey", F.col("o_totalprice").alias("truth"),
                                    "o_totalprice")
    holed = inject.mcar_column(full, 0.1, "o_totalprice", ORDER_KEYS)
    return holed.withColumn("fold_id", F.floor(row_unit(1, ORDER_KEYS, "fold") * 4) + 1)


def g4_fold_reveal(spark, sf):
    return _folded(spark, sf).select("o_orderkey", folds.fold_reveal(
        "o_totalprice", "truth", "fold_id", 2).alias("o_totalprice"))


def g5_compact_context(spark, sf):
    holed = inject.mcar_column(
        orders(spark, sf).select("o_orderkey", "o_totalprice"), 0.1, "o_totalprice", ORDER_KEYS)
    placed = with_position(holed, ORDER_KEYS).withColumn(
        "required", F.col("o_totalprice").isNull() & (row_unit(1, ORDER_KEYS, "need") < 0.05))
    return folds.compact_context(placed, "o_totalprice", "required", 400)


def g6_fold_train_median(spark, sf):
    return folds.fold_train_median(_folded(spark, sf), "o_totalprice", "fold_id", 4).withColumn(
        "train_median", F.round("train_median", 4))


def g7_cross_validate(spark, sf):
    rows = lines(spark, sf).drop("l_returnflag", "l_linestatus")
    answers, split = cross_validate(rows, "l_charge", LINE_KEYS, "mice", 3)
    scores = evaluate.answer_metrics(answers, ["fold_id"])
    return scores.join(split, "fold_id")


def h8_running_mae(spark, sf):
    detail = orders(spark, sf).select(
        "o_orderkey", "o_orderstatus", F.when(
            row_unit(1, ORDER_KEYS, "scored") < 0.9, F.floor("o_totalprice")).alias("abs_error"))
    return evaluate.running_mae(detail, ["o_orderstatus"], ORDER_KEYS).withColumn(
        "running_mae", F.round("running_mae", 6))


QUERIES = {f.__name__: f for f in (
    g1_contiguous_folds, g2_stratify_bins, g2_stratify_bins_ties, g3_stratified_kfold,
    g4_fold_reveal, g5_compact_context, g6_fold_train_median, g7_cross_validate, h8_running_mae)}


def _bins(value: str, q: int) -> str:
    """Position, then the bin as the ceiling of position * q / (n - 1)."""
    return f"""placed AS (SELECT o_orderkey, {value} AS v, row_number() OVER
    (ORDER BY {value}, o_orderkey) - 1 AS p, count(*) OVER () AS n FROM orders),
  binned AS (SELECT o_orderkey, v, greatest(0, (p * {q} + n - 2) // (n - 1) - 1)::INTEGER AS bin
    FROM placed)"""


_FOLDED = f"""{sql_holed_orders()}, folded AS (SELECT *, floor(
    {sql_unit(1, ORDER_KEYS, "fold")} * 4)::BIGINT + 1 AS fold_id FROM holed)"""

SQL = {
    "g1_contiguous_folds": """SELECT o_orderkey, ntile(7) OVER (ORDER BY o_orderkey)::INTEGER
  AS fold_id FROM orders""",
    "g2_stratify_bins": f"""WITH {_bins("o_totalprice", 10)}
  SELECT o_orderkey, v AS o_totalprice, bin FROM binned""",
    "g2_stratify_bins_ties": f"""WITH {_bins("(o_custkey % 3)", 3)}
  SELECT o_orderkey, v AS kind, bin FROM binned""",
    "g3_stratified_kfold": f"""WITH {_bins("o_totalprice", 10)}
  SELECT o_orderkey, v AS o_totalprice, bin, ((row_number() OVER (PARTITION BY bin ORDER BY
    {sql_unit(42, ORDER_KEYS, "fold")}) - 1) % 5 + 1)::INTEGER AS fold_id FROM binned""",
    "g4_fold_reveal": f"""WITH {_FOLDED} SELECT o_orderkey, CASE WHEN NOT (o_totalprice IS NULL
    AND fold_id = 2) THEN truth END AS o_totalprice FROM folded""",
    "g5_compact_context": f"""WITH {sql_holed_orders()},
  p AS (SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_orderkey) - 1 AS position,
    o_totalprice IS NULL AND {sql_unit(1, ORDER_KEYS, "need")} < 0.05::DOUBLE AS required
    FROM holed),
  d AS (SELECT *, least(
    position - max(CASE WHEN required THEN position END) OVER (ORDER BY position),
    min(CASE WHEN required THEN position END) OVER (ORDER BY position DESC) - position) AS near
    FROM p),
  r AS (SELECT *, row_number() OVER (ORDER BY CASE WHEN required THEN -1 ELSE near END, position)
    - 1 AS context_position, count(*) FILTER (required) OVER () AS m FROM d
    WHERE required OR o_totalprice IS NOT NULL)
  SELECT o_orderkey, o_totalprice, position, required, context_position FROM r
  WHERE context_position < greatest(400, m)""",
    "g6_fold_train_median": f"""WITH {_FOLDED} SELECT f::INTEGER AS fold_id,
    round(median(o_totalprice), 4) AS train_median
  FROM folded, range(1, 5) r(f) WHERE fold_id <> f GROUP BY f""",
    "h8_running_mae": f"""WITH d AS (SELECT o_orderkey, o_orderstatus, CASE WHEN
    {sql_unit(1, ORDER_KEYS, "scored")} < 0.9::DOUBLE THEN floor(o_totalprice)::BIGINT END
    AS abs_error FROM orders)
  SELECT *, round(avg(abs_error) OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey
    ROWS UNBOUNDED PRECEDING), 6) AS running_mae FROM d""",
}
