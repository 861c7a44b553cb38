"""Scores of filled cells."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.hashing import row_unit
from ..operators import evaluate, inject
from ..operators.simple import MeanMode
from ..plans.benchmark import log_result
from ..session import scratch_path
from ..sources.results import RESULT_TABLES, read_results
from .fixtures import ORDER_KEYS, orders, sql_keep, sql_unit

_COLUMNS = ["o_custkey", "o_totalprice"]


def _pair(spark, sf):
    """Truth, holes and mean fills of two order columns side by side."""
    full = orders(spark, sf).select("o_orderkey", *_COLUMNS)
    # A truth that is itself unknown for some rows.
    full = inject.mcar(full, 0.02, ORDER_KEYS, 5, ["o_totalprice"])
    holed = inject.mcar(full, 0.1, ORDER_KEYS)
    filled = MeanMode(ORDER_KEYS).fit_transform(holed)
    return evaluate.side_by_side(full, holed, filled, ORDER_KEYS, _COLUMNS)


def h1_rmse(spark, sf):
    return evaluate.rmse(_pair(spark, sf), _COLUMNS).withColumn("rmse", F.round("rmse", 4))


def h2_nrmse_std(spark, sf):
    return evaluate.nrmse(_pair(spark, sf), _COLUMNS).withColumn("nrmse", F.round("nrmse", 8))


def h2_nrmse_range(spark, sf):
    return evaluate.nrmse(_pair(spark, sf), _COLUMNS, "range").withColumn(
        "nrmse", F.round("nrmse", 8))


def h3_evaluate_target(spark, sf):
    return evaluate.evaluate_target(_pair(spark, sf), "o_totalprice").select(
        F.round("mean_rmse", 4).alias("mean_rmse"), F.round("mean_nrmse", 8).alias("mean_nrmse"),
        "n_masked_target", "n_unfilled")


_RUN = {"dataset": "Orders", "missingness_type": "MCAR", "missing_rate": "10%",
        "imputation_method": "Mean/Mode"}


def h4_detail_rows(spark, sf):
    detail = evaluate.detail_rows(_pair(spark, sf), ORDER_KEYS, _COLUMNS, _RUN)
    return detail.withColumns({
        "prediction": F.round("prediction", 6), "abs_error": F.round("abs_error", 6)})


def _answers(spark, sf):
    """Answers of two stand-in models to the holes."""
    u = row_unit(8, ORDER_KEYS, "answer")
    return orders(spark, sf).select(
        "o_orderkey", "o_orderstatus",
        F.when(u < 0.95, F.col("o_totalprice") * (0.5 + u)).alias("prediction"),
        F.when(u > 0.02, F.col("o_totalprice")).alias("ground_truth"),
        F.when(u < 0.7, F.lit("model_first_try")).when(u < 0.8, F.lit("model_retry"))
        .when(u < 0.99, F.lit("fallback_median")).alias("source"))


def _rounded(df):
    return df.withColumns({c: F.round(c, p) for c, p in (
        ("mean_rmse", 4), ("mean_nrmse", 8), ("fallback_rate", 9)) if c in df.columns})


def h5_answer_metrics(spark, sf):
    return _rounded(evaluate.answer_metrics(_answers(spark, sf), ["o_orderstatus"]))


def h6_nrmse_full_population(spark, sf):
    return _rounded(evaluate.nrmse_full_population(
        _answers(spark, sf), orders(spark, sf), "o_totalprice"))


def h7_source_counts(spark, sf):
    return evaluate.source_counts(_answers(spark, sf), ["o_orderstatus"])


def h9_mean_over_columns(spark, sf):
    return _rounded(evaluate.mean_over_columns(
        evaluate.column_scores(_pair(spark, sf), _COLUMNS)))


def h10_log_result(spark, sf):
    """Written twice and read back: the second call adds nothing."""
    root, keys = scratch_path(spark, "results"), list(_RUN)
    for _ in range(2):
        log_result(_pair(spark, sf), ORDER_KEYS, _COLUMNS, _RUN, root)
    detail, rmse, nrmse = (read_results(spark, root, name).drop("run_id") for name in RESULT_TABLES)
    n = detail.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_detail_rows"))
    return _rounded(rmse.join(nrmse, keys).join(n, keys))


QUERIES = {f.__name__: f for f in (
    h1_rmse, h2_nrmse_std, h2_nrmse_range, h3_evaluate_target, h4_detail_rows, h5_answer_metrics,
    h6_nrmse_full_population, h7_source_counts, h9_mean_over_columns, h10_log_result)}

_HOLE = {c: sql_unit(42, ORDER_KEYS, c) + " < 0.1::DOUBLE" for c in _COLUMNS}
_PAIR = f"""truth AS (SELECT o_orderkey, o_custkey, {sql_keep(5, ORDER_KEYS, "o_totalprice", 0.02)}
    AS o_totalprice FROM orders),
  pair AS (SELECT o_orderkey, {", ".join(
      f"{c} AS {c}_t, CASE WHEN NOT ({_HOLE[c]}) THEN {c} END AS {c}_h" for c in _COLUMNS)}
    FROM truth),
  long AS ({" UNION ALL ".join(
      f"SELECT o_orderkey, '{c}' AS column_name, {c}_t::DOUBLE AS t, {c}_h IS NULL AS hole, "
      f"coalesce({c}_h, avg({c}_h) OVER ())::DOUBLE AS f FROM pair" for c in _COLUMNS)}),
  scored AS (SELECT column_name,
    sqrt(avg((t - f) ** 2) FILTER (hole AND t IS NOT NULL)) AS rmse,
    stddev_pop(t) FILTER (hole) AS sd, max(t) FILTER (hole) - min(t) FILTER (hole) AS span,
    count(*) FILTER (hole AND t IS NOT NULL) AS n FROM long GROUP BY 1)"""
_ANSWERS = f"""a AS (SELECT *, {sql_unit(8, ORDER_KEYS, "answer")} AS u FROM orders),
  answers AS (SELECT o_orderstatus, CASE WHEN u < 0.95 THEN o_totalprice * (0.5::DOUBLE + u) END AS p,
    CASE WHEN u > 0.02 THEN o_totalprice END AS t,
    CASE WHEN u < 0.7 THEN 'model_first_try' WHEN u < 0.8 THEN 'model_retry'
      WHEN u < 0.99 THEN 'fallback_median' END AS source FROM a)"""
_VALID = "FROM answers WHERE p IS NOT NULL AND t IS NOT NULL"
_EPS = "1e-8::DOUBLE"
_RUN_SQL = ", ".join(f"'{v}' AS {k}" for k, v in _RUN.items())

SQL = {
    "h1_rmse": f"WITH {_PAIR} SELECT column_name, round(rmse, 4) AS rmse FROM scored",
    "h2_nrmse_std": f"""WITH {_PAIR} SELECT column_name, round(rmse / (sd + {_EPS}), 8) AS nrmse
  FROM scored""",
    "h2_nrmse_range": f"""WITH {_PAIR} SELECT column_name, round(rmse / (span + {_EPS}), 8) AS nrmse
  FROM scored""",
    "h3_evaluate_target": f"""WITH {_PAIR} SELECT round(rmse, 4) AS mean_rmse,
  round(rmse / (sd + {_EPS}), 8) AS mean_nrmse, n AS n_masked_target, 0::BIGINT AS n_unfilled
  FROM scored WHERE column_name = 'o_totalprice'""",
    "h4_detail_rows": f"""WITH {_PAIR} SELECT {_RUN_SQL}, o_orderkey, column_name,
  round(f, 6) AS prediction, t AS ground_truth, round(abs(f - t), 6) AS abs_error,
  'tabular_imputer' AS source FROM long WHERE hole AND t IS NOT NULL""",
    "h5_answer_metrics": f"""WITH {_ANSWERS} SELECT o_orderstatus, count(*) AS n_valid,
  round(sqrt(avg((t - p) ** 2)), 4) AS mean_rmse,
  round(sqrt(avg((t - p) ** 2)) / (stddev_pop(t) + {_EPS}), 8) AS mean_nrmse,
  round(avg(CASE WHEN source = 'model_first_try' THEN 0.0::DOUBLE ELSE 1 END), 9) AS fallback_rate
  {_VALID} GROUP BY 1""",
    "h6_nrmse_full_population": f"""WITH {_ANSWERS} SELECT count(*) AS n_valid,
  round(sqrt(avg((t - p) ** 2)), 4) AS mean_rmse, round(sqrt(avg((t - p) ** 2)) /
    ((SELECT stddev_pop(o_totalprice) FROM orders) + {_EPS}), 8) AS mean_nrmse {_VALID}""",
    "h7_source_counts": f"""WITH {_ANSWERS} SELECT o_orderstatus, source, count(*) AS n_rows
  FROM answers GROUP BY 1, 2""",
    "h9_mean_over_columns": f"""WITH {_PAIR} SELECT round(avg(rmse), 4) AS mean_rmse,
  round(avg(rmse / (sd + {_EPS})), 8) AS mean_nrmse FROM scored""",
    "h10_log_result": f"""WITH {_PAIR} SELECT {_RUN_SQL}, round(avg(rmse), 4) AS mean_rmse,
  round(avg(rmse / (sd + {_EPS})), 8) AS mean_nrmse, sum(n)::BIGINT AS n_detail_rows
  FROM scored""",
}
