"""Imputers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import row_unit
from ..operators import encode, evaluate, inject
from ..operators.dae import DenoisingImputer
from ..operators.fallback import domain_fallback
from ..operators.forest import MissForest, convergence_delta
from ..operators.mice import Mice
from ..operators.order import exact_quantiles
from ..operators.registry import build_imputer
from ..operators.simple import MeanMode, MedianMode
from ..session import scratch_path, store
from ..streaming.fill import fill_stream, read_stream
from .fixtures import (
    LINE_KEYS, LINES, ORDER_KEYS, lines, load, orders, sql_hex, sql_holed_orders, sql_keep,
    sql_unit)

_MIXED = ["o_orderstatus", "o_totalprice", "o_orderpriority"]


def _holed_mixed(spark, sf):
    return inject.mcar(orders(spark, sf), 0.1, ORDER_KEYS, 42, _MIXED)


def _orders_result(df):
    return df.select("o_orderkey", F.col("o_custkey").cast("long").alias("o_custkey"),
                     "o_orderstatus", "o_orderpriority", F.round("o_totalprice", 4).alias("o_totalprice"))


def slice_mcar_meanmode_nrmse(spark, sf):
    target = ["o_totalprice"]
    full = evaluate.with_truth(orders(spark, sf).select(*ORDER_KEYS, *target), target)
    holed = evaluate.with_holes(inject.mcar_column(full, 0.1, target[0], ORDER_KEYS), target)
    filled = MeanMode([*ORDER_KEYS, *evaluate.carried(target)]).fit_transform(holed)
    return evaluate.evaluate_target(evaluate.as_filled(filled, target), target[0]).select(
        F.round("mean_rmse", 4).alias("mean_rmse"), F.round("mean_nrmse", 8).alias("mean_nrmse"),
        "n_masked_target", "n_unfilled")


def d1_meanmode(spark, sf):
    return _orders_result(MeanMode(ORDER_KEYS).fit_transform(_holed_mixed(spark, sf)))


def d2_medianmode(spark, sf):
    return _orders_result(MedianMode(ORDER_KEYS).fit_transform(_holed_mixed(spark, sf)))


def _one_target(spark, sf):
    return inject.mcar_column(lines(spark, sf), 0.1, "l_charge", LINE_KEYS)


def _all_columns(spark, sf):
    return inject.mcar_excluding(lines(spark, sf), 0.1, ["l_tax", "l_linestatus"], LINE_KEYS)


def _line_result(df):
    return df.select(*LINE_KEYS, *[c for c in df.columns if c not in LINE_KEYS])


def d3_mice(spark, sf):
    return _line_result(Mice(LINE_KEYS).fit_transform(_one_target(spark, sf)))


def d3_mice_global(spark, sf):
    return _line_result(Mice(LINE_KEYS).fit_transform(_all_columns(spark, sf)))


def d4_mice_posterior(spark, sf):
    mice = Mice(LINE_KEYS, sample_posterior=True, n_imputations=5)
    return _line_result(mice.fit_transform(_one_target(spark, sf)))


def d5_missforest(spark, sf):
    """200 trees at full depth."""
    return _line_result(MissForest(LINE_KEYS).fit_transform(_one_target(spark, sf)))


def d6_convergence_delta(spark, sf):
    staged = lines(spark, sf).select(
        F.col("l_charge").alias("old__charge"), F.col("l_extendedprice").alias("new__charge"),
        (F.col("l_returnflag") == "A").cast("double").alias("old__flag"),
        (F.col("l_linestatus") == "F").cast("double").alias("new__flag"),
        (row_unit(42, LINE_KEYS, "delta") < 0.2).alias("hole"))
    numeric, categorical = convergence_delta(staged, {"charge": "hole"}, {"flag": "hole"}, new="new__")
    return spark.createDataFrame(
        [(round(numeric, 9), round(categorical, 9))],
        "numeric_delta double, categorical_delta double")


def d7_denoising(spark, sf):
    holed = _all_columns(spark, sf).drop("l_returnflag", "l_linestatus")
    return _line_result(DenoisingImputer(LINE_KEYS).fit_transform(holed))


def d8_ordinal_encode(spark, sf):
    rows = lines(spark, sf).where(F.col("l_returnflag") != "N")
    known = encode.category_list(rows, "l_returnflag")
    every = lines(spark, sf).select(*LINE_KEYS, "l_returnflag", "l_quantity")
    codes = encode.encode("l_returnflag", known)
    return every.select(*LINE_KEYS, codes.alias("code"), encode.decode(
        F.col("l_quantity") / 20 - 1, known).alias("decoded"))


def d8_encode_by_join(spark, sf):
    parts = load(spark, sf, "part").select("p_partkey", "p_name")
    codes = encode.category_codes(parts.where(F.col("p_partkey") > 50), "p_name")
    return encode.encode_by_join(parts, "p_name", codes, "code").select("p_partkey", "code")


def d9_domain_fallback(spark, sf):
    rows = lines(spark, sf).withColumn("l_net", 1 - F.col("l_discount"))
    # Holes in the target and, for some rows, in a factor.
    holed = inject.mcar(rows, 0.2, LINE_KEYS, 42, ["l_charge", "l_net"])
    median = exact_quantiles(holed, ["l_charge"], [0.5])["l_charge"][0]
    out = domain_fallback(holed, "l_charge", ["l_extendedprice", "l_net"], median)
    return out.select(*LINE_KEYS, F.round("fallback_value", 6).alias("fallback_value"),
                      "fallback_source")


def _scores_by_key(spark, sf, imputers):
    """Scores of imputers on one holed column, without joining truth and fills."""
    target = ["l_charge"]
    full = lines(spark, sf).drop("l_returnflag", "l_linestatus")
    holed = store(evaluate.with_holes(inject.mcar_column(
        evaluate.with_truth(full, target), 0.1, "l_charge", LINE_KEYS), target), *LINE_KEYS)
    parts = []
    for key in imputers:
        imputer = build_imputer(key, 42, [*LINE_KEYS, *evaluate.carried(target)])
        score = evaluate.evaluate_target(
            evaluate.as_filled(imputer.fit_transform(holed), target), "l_charge")
        parts.append(score.select(F.lit(key).alias("method_key"), "*"))
    return reduce(DataFrame.unionByName, parts)


def d10_imputers_by_key(spark, sf):
    return _scores_by_key(spark, sf, ("meanmode", "medianmode", "mice", "missforest", "dae"))


def d10_simple_imputers_by_key(spark, sf):
    return _scores_by_key(spark, sf, ("meanmode", "medianmode")).withColumns({
        "mean_rmse": F.round("mean_rmse", 4), "mean_nrmse": F.round("mean_nrmse", 8)})


def d11_streaming_fill(spark, sf):
    whole = load(spark, sf, "orders")
    keep = [c for c in whole.columns if c != "o_orderdate"]
    holed = inject.mcar(whole.select(*keep), 0.1, ORDER_KEYS, 42, _MIXED)
    model = MeanMode(ORDER_KEYS).fit(holed)
    stream = read_stream(spark, sf, whole.schema, "orders.parquet").select(*keep)
    output = scratch_path(spark, "filled")
    query = fill_stream(inject.mcar(stream, 0.1, ORDER_KEYS, 42, _MIXED), model, output,
                        scratch_path(spark, "stream-state"))
    query.awaitTermination()
    return _orders_result(spark.read.parquet(output))


QUERIES = {f.__name__: f for f in (
    slice_mcar_meanmode_nrmse, d1_meanmode, d2_medianmode, d3_mice, d3_mice_global,
    d4_mice_posterior, d5_missforest, d6_convergence_delta, d7_denoising, d8_ordinal_encode,
    d8_encode_by_join, d9_domain_fallback, d10_imputers_by_key,
    d10_simple_imputers_by_key, d11_streaming_fill)}

_HOLED_MIXED = f"""holed AS (SELECT o_orderkey, o_custkey,
  {", ".join(f"{sql_keep(42, ORDER_KEYS, c, 0.1)} AS {c}" for c in _MIXED)} FROM orders)"""


def _mode(column: str) -> str:
    return (f"(SELECT {column} FROM holed WHERE {column} IS NOT NULL GROUP BY 1 "
            "ORDER BY count(*) DESC, 1 LIMIT 1)")


def _simple(centre: str) -> str:
    return f"""WITH {_HOLED_MIXED} SELECT o_orderkey, o_custkey,
  coalesce(o_orderstatus, {_mode("o_orderstatus")}) AS o_orderstatus,
  coalesce(o_orderpriority, {_mode("o_orderpriority")}) AS o_orderpriority,
  round(coalesce(o_totalprice, (SELECT {centre}(o_totalprice) FROM holed)), 4) AS o_totalprice
  FROM holed"""


_K = ", ".join(LINE_KEYS)


def _simple_score(key: str, centre: str) -> str:
    return f"""SELECT '{key}' AS method_key,
    round(sqrt(avg((t - c) ** 2)), 4) AS mean_rmse,
    round(sqrt(avg((t - c) ** 2)) / (stddev_pop(t) + 1e-8::DOUBLE), 8) AS mean_nrmse,
    count(*) AS n_masked_target, 0::BIGINT AS n_unfilled
  FROM (SELECT l_charge AS t, hole, (SELECT {centre}(l_charge) FROM marked WHERE NOT hole) AS c
    FROM marked) WHERE hole"""



SQL = {
    "slice_mcar_meanmode_nrmse": f"""WITH {sql_holed_orders()},
  filled AS (SELECT truth, o_totalprice AS h,
    coalesce(o_totalprice, avg(o_totalprice) OVER ()) AS f FROM holed),
  s AS (SELECT sqrt(avg(CASE WHEN h IS NULL THEN (truth - f) ** 2 END)) AS r,
    stddev_pop(CASE WHEN h IS NULL THEN truth END) AS d,
    count(*) FILTER (h IS NULL AND truth IS NOT NULL) AS n FROM filled)
  SELECT round(r, 4) AS mean_rmse, round(r / (d + 1e-8::DOUBLE), 8) AS mean_nrmse,
    n AS n_masked_target, 0::BIGINT AS n_unfilled FROM s""",
    "d1_meanmode": _simple("avg"),
    "d2_medianmode": _simple("median"),
    "d6_convergence_delta": f"""WITH {LINES}, s AS (SELECT l_charge AS a, l_extendedprice AS b,
    (l_returnflag = 'A') AS c, (l_linestatus = 'F') AS d FROM lines
    WHERE {sql_unit(42, LINE_KEYS, "delta")} < 0.2::DOUBLE)
  SELECT round(sum((b - a) ** 2) / sum(b ** 2), 9) AS numeric_delta,
    round(count(*) FILTER (c <> d)::DOUBLE / count(*), 9) AS categorical_delta FROM s""",
    "d8_ordinal_encode": f"""WITH known AS (SELECT l_returnflag AS value,
    row_number() OVER (ORDER BY l_returnflag) - 1 AS code, count(*) OVER () AS k
    FROM (SELECT DISTINCT l_returnflag FROM lineitem WHERE l_returnflag <> 'N'))
  SELECT {_K}, coalesce(e.code, -1)::DOUBLE AS code, d.value AS decoded FROM lineitem
  LEFT JOIN known e ON e.value = l_returnflag
  JOIN known d ON d.code = greatest(0, least(round_even(l_quantity / 20 - 1, 0), d.k - 1))""",
    "d8_encode_by_join": """WITH known AS (SELECT p_name AS value,
    row_number() OVER (ORDER BY p_name) - 1 AS code
    FROM (SELECT DISTINCT p_name FROM part WHERE p_partkey > 50))
  SELECT p_partkey, coalesce(code, -1)::DOUBLE AS code FROM part
  LEFT JOIN known ON value = p_name""",
    "d9_domain_fallback": f"""WITH {LINES}, net AS (SELECT *, 1 - l_discount AS l_net FROM lines),
  holed AS (SELECT {_K}, l_extendedprice, {sql_keep(42, LINE_KEYS, "l_charge", 0.2)} AS l_charge,
    {sql_keep(42, LINE_KEYS, "l_net", 0.2)} AS l_net FROM net)
  SELECT {_K}, CASE WHEN l_charge IS NULL THEN round(coalesce(l_extendedprice * l_net,
      (SELECT median(l_charge) FROM holed)), 6) END AS fallback_value,
    CASE WHEN l_charge IS NULL THEN CASE WHEN l_extendedprice * l_net IS NOT NULL
      THEN 'fallback_l_extendedprice_x_l_net' ELSE 'fallback_median' END END AS fallback_source
  FROM holed""",
    "d10_simple_imputers_by_key": f"""WITH {LINES}, marked AS (SELECT l_charge,
    row_number() OVER (ORDER BY {sql_hex(42, LINE_KEYS, "'l_charge'")})
      <= floor(0.1::DOUBLE * count(*) OVER ()) AS hole FROM lines)
  {_simple_score("meanmode", "avg")} UNION ALL {_simple_score("medianmode", "median")}""",
    "d11_streaming_fill": _simple("avg"),
}
