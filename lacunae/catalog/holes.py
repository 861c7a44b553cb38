"""Holes and ranks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import inject
from ..operators.order import with_average_rank
from ..plans.scenarios import ScenarioSpec, scenario_rows
from .fixtures import (
    LINE_KEYS, LINES, ORDER_KEYS, lines, orders, sql_hex, sql_holed_orders, sql_keep, sql_slice)

_ORDER_COLUMNS = ["o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"]


def c1_mcar(spark, sf):
    return inject.mcar(orders(spark, sf), 0.1, ORDER_KEYS)


def c2_mcar_single_feature(spark, sf):
    return inject.mcar_column(orders(spark, sf), 0.1, "o_totalprice", ORDER_KEYS).select(
        "o_orderkey", "o_totalprice")


def _line_result(df):
    return df.select(*LINE_KEYS, F.round("l_charge", 6).alias("l_charge"))


def c3_mar(spark, sf):
    return _line_result(inject.mar(
        lines(spark, sf), "l_extendedprice", "l_charge", 0.1, LINE_KEYS))


def c4_mnar(spark, sf):
    return _line_result(inject.mnar(lines(spark, sf), "l_charge", 0.1, LINE_KEYS))


def c5_mcar_global_excluding(spark, sf):
    return inject.mcar_excluding(
        orders(spark, sf), 0.15, ["o_custkey", "o_orderstatus"], ORDER_KEYS)


_SPEC = ScenarioSpec("orders", "Orders", "o_totalprice", "o_custkey", ("o_orderkey",),
                     ("o_custkey", "o_orderstatus"))


def c6_generate_scenarios(spark, sf):
    """All eight scenarios from one scan of the staged rows."""
    hole = F.col("o_totalprice").isNull()
    return scenario_rows(orders(spark, sf), _SPEC).groupBy("scenario_family", "rate_pct").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(hole).alias("n_holes"),
        F.sum(F.when(hole, F.col("o_orderkey"))).alias("hole_keys"),
        F.count_if(F.col("o_orderpriority").isNull()).alias("other_holes"))


def c7_average_rank(spark, sf):
    return with_average_rank(
        lines(spark, sf).select(*LINE_KEYS, "l_extendedprice"), "l_extendedprice")


def c7_average_rank_ties(spark, sf):
    return with_average_rank(
        lines(spark, sf).select(*LINE_KEYS, "l_quantity"), "l_quantity")


QUERIES = {f.__name__: f for f in (
    c1_mcar, c2_mcar_single_feature, c3_mar, c4_mnar, c5_mcar_global_excluding,
    c6_generate_scenarios, c7_average_rank, c7_average_rank_ties)}


def _ranked_draw(table: str, driver: str, target: str, keys: list[str], rate: float,
                 columns: str) -> str:
    digits = sql_hex(42, keys, f"'{target}'")
    return f"""SELECT {columns}, CASE WHEN row_number() OVER (ORDER BY draw, digits) >
      round_even({rate}::DOUBLE * count(*) OVER (), 0) THEN {target} END AS {target}
    FROM (SELECT *, -ln({sql_slice("digits")}) / w AS draw FROM (
      SELECT *, {digits} AS digits, rank() OVER (ORDER BY {driver})
        + (count(*) OVER (PARTITION BY {driver}) - 1) / 2.0::DOUBLE AS w FROM {table}))"""


_KEYS = ", ".join(LINE_KEYS)


def _scenario(family: str, rate: float) -> str:
    if family == "MCAR_TARGET":
        digits = sql_hex(42, ORDER_KEYS, "'o_totalprice'")
        body = f"""SELECT o_orderkey, o_orderpriority, CASE WHEN row_number() OVER
          (ORDER BY {digits}) > floor({rate}::DOUBLE * count(*) OVER ()) THEN o_totalprice END
          AS o_totalprice FROM orders"""
    elif family == "MCAR_GLOBAL":
        body = f"""SELECT o_orderkey, {sql_keep(42, ORDER_KEYS, "o_orderpriority", rate)}
          AS o_orderpriority, {sql_keep(42, ORDER_KEYS, "o_totalprice", rate)} AS o_totalprice
          FROM orders"""
    else:
        driver = "o_custkey" if family == "MAR_TARGET" else "o_totalprice"
        body = _ranked_draw("orders", driver, "o_totalprice", ORDER_KEYS, rate,
                            "o_orderkey, o_orderpriority")
    return f"""SELECT '{family}' AS scenario_family, {round(rate * 100)} AS rate_pct,
      count(*) AS n_rows, count(*) - count(o_totalprice) AS n_holes,
      sum(CASE WHEN o_totalprice IS NULL THEN o_orderkey END)::BIGINT AS hole_keys,
      count(*) - count(o_orderpriority) AS other_holes FROM ({body})"""


def _average_rank(column: str) -> str:
    return f"""SELECT {_KEYS}, {column}, rank() OVER (ORDER BY {column})
      + (count(*) OVER (PARTITION BY {column}) - 1) / 2.0::DOUBLE AS rank FROM lineitem"""


def _rounded(body: str) -> str:
    return f"WITH {LINES} SELECT * REPLACE (round(l_charge, 6) AS l_charge) FROM ({body})"


SQL = {
    "c1_mcar": "SELECT o_orderkey, " + ", ".join(
        f"{sql_keep(42, ORDER_KEYS, c, 0.1)} AS {c}" for c in _ORDER_COLUMNS) + " FROM orders",
    "c2_mcar_single_feature":
        f"WITH {sql_holed_orders()} SELECT o_orderkey, o_totalprice FROM holed",
    "c3_mar": _rounded(_ranked_draw(
        "lines", "l_extendedprice", "l_charge", LINE_KEYS, 0.1, _KEYS)),
    "c4_mnar": _rounded(_ranked_draw("lines", "l_charge", "l_charge", LINE_KEYS, 0.1, _KEYS)),
    "c5_mcar_global_excluding": f"""SELECT o_orderkey, o_custkey, o_orderstatus,
      {sql_keep(42, ORDER_KEYS, "o_totalprice", 0.15)} AS o_totalprice,
      {sql_keep(42, ORDER_KEYS, "o_orderpriority", 0.15)} AS o_orderpriority FROM orders""",
    "c6_generate_scenarios": " UNION ALL ".join(
        _scenario(f, r) for r in (0.1, 0.15)
        for f in ("MAR_TARGET", "MNAR_TARGET", "MCAR_TARGET", "MCAR_GLOBAL")),
    "c7_average_rank": _average_rank("l_extendedprice"),
    "c7_average_rank_ties": _average_rank("l_quantity"),
}
