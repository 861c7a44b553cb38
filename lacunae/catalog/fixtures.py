"""Tables and SQL fragments that several queries share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import spread

LINE_KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
ORDER_KEYS = ["o_orderkey"]
CUSTOMER_KEYS = ["c_custkey"]


def load(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A given table; one that is a single split is spread over the cores by its first column."""
    table = spark.read.parquet(f"{sf}/{name}.parquet")
    return spread(table, table.columns[0])


def lines(spark: SparkSession, sf: str) -> DataFrame:
    """Line items with a target that follows from the other columns."""
    charge = F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))
    return load(spark, sf, "lineitem").select(
        *LINE_KEYS, "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag",
        "l_linestatus", charge.alias("l_charge"))


def orders(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")


def customers(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "customer").select(
        "c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment")


LINES = """lines AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount,
         l_tax, l_returnflag, l_linestatus,
         l_extendedprice * (1 - l_discount) * (1 + l_tax) AS l_charge
  FROM lineitem)"""


def sql_hex(seed: int, keys: list[str], salt: str) -> str:
    parts = ", ".join(f"{k}::VARCHAR" for k in keys)
    return f"md5(concat_ws(':', '{seed}', {parts}, {salt}))"


def sql_slice(digits: str, start: int = 1) -> str:
    return (f"((('0x' || substr({digits}, {start}, 13))::UBIGINT)::DOUBLE + 0.5::DOUBLE)"
            " / 4503599627370496::DOUBLE")


def sql_unit(seed: int, keys: list[str], salt: str) -> str:
    return sql_slice(sql_hex(seed, keys, f"'{salt}'"))


def sql_keep(seed: int, keys: list[str], column: str, fraction: float) -> str:
    """Column with holes where the cell's number is below the fraction."""
    return (f"CASE WHEN {sql_unit(seed, keys, column)} >= {fraction}::DOUBLE "
            f"THEN {column} END")


def sql_holed_orders(fraction: float = 0.1, seed: int = 42) -> str:
    """CTE `holed`: orders with exactly int(fraction * n) holes in o_totalprice."""
    digits = sql_hex(seed, ORDER_KEYS, "'o_totalprice'")
    return f"""holed AS (
  SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority, o_totalprice AS truth,
         CASE WHEN row_number() OVER (ORDER BY {digits}) >
              floor({fraction}::DOUBLE * count(*) OVER ()) THEN o_totalprice END AS o_totalprice
  FROM orders)"""
