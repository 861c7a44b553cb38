"""Sources, sinks, typing and profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.hashing import row_unit
from ..operators import inject, profile
from ..session import scratch_path
from ..sources import results, tables
from .fixtures import (
    LINE_KEYS, LINES, ORDER_KEYS, lines, load, orders, sql_holed_orders, sql_keep, sql_unit)


def a1_read_table(spark, sf):
    path = scratch_path(spark, "orders-csv")
    rows = orders(spark, sf)
    rows.write.option("header", True).csv(path)
    return tables.read_table(spark, path, rows.schema).groupBy("o_orderstatus").agg(
        F.count(F.lit(1)).alias("n_rows"), F.round(F.sum("o_totalprice"), 2).alias("total"))


def a2_read_whitespace(spark, sf):
    text = load(spark, sf, "lineitem").select(
        F.concat(F.lit("  "), F.concat_ws("   ", *LINE_KEYS), F.lit(" ")).alias("value"))
    return tables.parse_whitespace(text, tables.statlog_names(4))


def a3_write_scenario(spark, sf):
    root = scratch_path(spark, "scenarios")
    rows = orders(spark, sf)
    for rate in (0.1, 0.15):
        holed = inject.mcar_column(rows, rate, "o_totalprice", ORDER_KEYS)
        tables.write_scenario(holed, root, "MCAR", "orders_target", rate)
    stored = spark.read.parquet(root)
    return stored.groupBy("mechanism", "scenario", "rate_pct").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.col("o_totalprice").isNull()).alias("n_missing"))


def a4_discover_scenarios(spark, sf):
    root = scratch_path(spark, "scenario-files")
    rows = orders(spark, sf)
    for mechanism in ("MAR", "MCAR"):
        rows.write.option("header", True).csv(f"{root}/{mechanism}")
    found = tables.discover_scenarios(spark, root, glob="*.csv")
    # How many part files there are depends on the cluster, but the rows in them do not.
    parts = [
        tables.read_table(spark, [r.path for r in found.where(F.col("mechanism") == m).collect()],
                          rows.schema).select(
            F.lit(m).alias("mechanism"), F.regexp_extract(F.input_file_name(), r"([^/]+)/[^/]+$", 1)
            .alias("folder"), "o_totalprice")
        for m in ("MAR", "MCAR")]
    return parts[0].unionByName(parts[1]).groupBy("mechanism", "folder").agg(
        F.count(F.lit(1)).alias("n_rows"), F.round(F.sum("o_totalprice"), 2).alias("total"))


def a5_chat_jsonl(spark, sf):
    path = scratch_path(spark, "chat")
    chat = load(spark, sf, "conversations").select(F.array(F.struct(
        "role", F.col("text").alias("content"))).alias("messages"))
    tables.write_chat_jsonl(chat, path)
    first = F.col("messages")[0]
    return tables.read_chat_jsonl(spark, path).groupBy(first["role"].alias("role")).agg(
        F.count(F.lit(1)).alias("n_records"),
        F.sum(F.length(first["content"])).alias("n_chars"))


def a6_append_union(spark, sf):
    rows = orders(spark, sf)
    old = rows.where(F.col("o_orderstatus") == "F").drop("o_orderpriority")
    new = rows.where(F.col("o_orderstatus") != "F").drop("o_custkey")
    return results.append_union(old, new)


def a7_replace_slice(spark, sf):
    rows = orders(spark, sf).select(
        "o_orderkey", F.concat(F.lit("Model "), "o_orderpriority").alias("imputation_method"),
        F.col("o_totalprice").alias("mean_rmse"))
    fresh = rows.where(F.col("o_orderkey") % 3 == 0).withColumn(
        "imputation_method", F.lit("Model 1-NEW"))
    return results.replace_slice(rows, fresh, "Model 1-")


def a8_setting_path(spark, sf):
    return load(spark, sf, "part").select("p_partkey", results.setting_path(
        F.col("p_brand"), F.col("p_type"), F.col("p_name"),
        F.when(F.col("p_size") > 25, F.concat(F.lit(" (v "), "p_size", F.lit(")"))))
        .alias("setting_path"))


def _text_orders(spark, sf):
    u = row_unit(7, ORDER_KEYS, "typing")
    return orders(spark, sf).select(
        "o_orderkey",
        F.when(u < 0.03, F.lit("n/a")).otherwise(
            F.concat(F.lit(" "), F.col("o_custkey").cast("string"), F.lit(" "))).alias("mostly"),
        F.when(u < 0.2, F.lit("x")).otherwise(F.col("o_custkey").cast("string")).alias("partly"),
        F.when(u < 0.5, F.lit("")).otherwise(F.lit("NaN")).alias("never"))


def b1_coerce_numeric(spark, sf):
    return profile.coerce_numeric(_text_orders(spark, sf), threshold=0.95)


def b1_number_literals(spark, sf):
    """Codes that a cast would read as numbers stay text, in whichever share they come."""
    u = row_unit(7, ORDER_KEYS, "literal")
    rows = orders(spark, sf).select(
        "o_orderkey", F.when(u < 0.5, F.concat("o_custkey", F.lit("d"))).when(
            u < 0.8, F.concat("o_custkey", F.lit("F"))).when(u < 0.9, "0x1p3").otherwise(
            F.col("o_custkey").cast("string")).alias("code"))
    return profile.coerce_numeric(rows, threshold=0.05).select(
        "o_orderkey", F.col("code").cast("double").alias("code"))


def b2_detect_id_columns(spark, sf):
    """Identifier columns of two tables, with their values counted."""
    parts = []
    for name, explicit in (("documents", []), ("customer", ["c_custkey"])):
        rows = load(spark, sf, name)
        ids = sorted(profile.detect_id_columns(rows, explicit))
        cells = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("v")) for c in ids])
        parts.append(rows.select(F.lit(name).alias("table_name"), F.inline(cells)))
    return parts[0].unionByName(parts[1]).groupBy("table_name", "column_name").agg(
        F.count("v").alias("n"), F.countDistinct("v").alias("n_distinct"))


def b9_feature_columns(spark, sf):
    rows = _holed_lines(spark, sf)
    features = profile.feature_columns(rows, "l_charge", LINE_KEYS)
    cells = F.array(*[F.struct(F.lit(i).alias("place"), F.lit(c).alias("column_name"),
                               F.col(c).isNotNull().cast("long").alias("v")) for i, c in enumerate(features)])
    return rows.select(F.inline(cells)).groupBy("place", "column_name").agg(F.sum("v").alias("n_observed"))


def b1_numeric_share(spark, sf):
    shares = profile.numeric_share(_text_orders(spark, sf))
    return spark.createDataFrame(
        [(c, round(s, 6)) for c, s in shares.items()], "column_name string, share double")


_GLOBAL = ["l_quantity", "l_extendedprice", "l_charge", "l_returnflag"]


def _holed_lines(spark, sf):
    return inject.mcar(lines(spark, sf), 0.1, LINE_KEYS, 42, _GLOBAL)


def b3_null_profile(spark, sf):
    return profile.null_profile(_holed_lines(spark, sf)).withColumn(
        "null_fraction", F.round("null_fraction", 9))


def b4_resolve_targets(spark, sf):
    rows = _holed_lines(spark, sf)
    ids = profile.detect_id_columns(rows, LINE_KEYS)
    first = profile.resolve_targets(rows, ids)
    every = profile.resolve_targets(rows, ids, "all_missing_numeric")
    return spark.createDataFrame(
        [("primary_missing", c) for c in first] + [("all_missing_numeric", c) for c in every],
        "mode string, target string")


def b5_prepare_pair(spark, sf):
    full = lines(spark, sf)
    full, holed = profile.prepare_pair(
        full, _holed_lines(spark, sf), [*LINE_KEYS, "l_linestatus"], numeric_only=True)
    return spark.createDataFrame(
        [(i, c) for i, c in enumerate(full.columns)], "place int, column_name string").crossJoin(
        holed.agg(F.count(F.lit(1)).alias("n_rows")))


def b6_target_summary(spark, sf):
    holed = inject.mcar_column(orders(spark, sf), 0.1, "o_totalprice", ORDER_KEYS)
    summary = profile.target_summary(holed, "o_totalprice")
    return spark.createDataFrame(
        [(k, round(v, 4)) for k, v in summary.items()], "statistic string, value double")


def b7_numeric_scales(spark, sf):
    columns = ["l_quantity", "l_extendedprice", "l_discount", "l_charge"]
    scales = profile.numeric_scales(lines(spark, sf), columns)
    return spark.createDataFrame(
        [(c, round(s, 6)) for c, s in scales.items()], "column_name string, scale double")


def b8_split_observed(spark, sf):
    holed = inject.mcar_column(orders(spark, sf), 0.1, "o_totalprice", ORDER_KEYS)
    observed, head = profile.split_observed(holed, "o_totalprice", 25, ORDER_KEYS)
    return head.select(F.lit("to_fill").alias("part"), "o_orderkey").unionByName(
        observed.select(F.lit("observed").alias("part"), "o_orderkey"))


QUERIES = {f.__name__: f for f in (
    a1_read_table, a2_read_whitespace, a3_write_scenario, a4_discover_scenarios, a5_chat_jsonl,
    a6_append_union, a7_replace_slice, a8_setting_path, b1_coerce_numeric, b1_numeric_share,
    b1_number_literals, b2_detect_id_columns, b3_null_profile, b4_resolve_targets, b5_prepare_pair, b6_target_summary, b7_numeric_scales,
    b8_split_observed, b9_feature_columns)}

_TYPED = f"""typed AS (SELECT *, {sql_unit(7, ORDER_KEYS, "typing")} AS u FROM orders),
text AS (SELECT o_orderkey,
  CASE WHEN u < 0.03 THEN 'n/a' ELSE ' ' || o_custkey::VARCHAR || ' ' END AS mostly,
  CASE WHEN u < 0.2 THEN 'x' ELSE o_custkey::VARCHAR END AS partly,
  CASE WHEN u < 0.5 THEN '' ELSE 'NaN' END AS never FROM typed)"""

_HOLED_LINES = f"""{LINES}, holed AS (SELECT * REPLACE (
  {", ".join(f"{sql_keep(42, LINE_KEYS, c, 0.1)} AS {c}" for c in _GLOBAL)}) FROM lines)"""


def _token(value: str) -> str:
    safe = f"trim(regexp_replace({value}, '[^A-Za-z0-9._-]+', '_', 'g'), '_')"
    return f"coalesce(nullif(lower({safe}), ''), 'unknown')"


_ALL_LINE_COLUMNS = [*LINE_KEYS, "l_quantity", "l_extendedprice", "l_discount", "l_tax",
                     "l_returnflag", "l_linestatus", "l_charge"]

SQL = {
    "a1_read_table": """SELECT o_orderstatus, count(*) AS n_rows,
  round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1""",
    "a2_read_whitespace": """SELECT l_orderkey::INTEGER AS X1, l_linenumber AS X2,
  l_partkey::INTEGER AS X3, l_suppkey::INTEGER AS "class" FROM lineitem""",
    "a3_write_scenario": """SELECT 'MCAR' AS mechanism, 'orders_target' AS scenario,
  pct AS rate_pct, count(*) AS n_rows, floor(pct / 100.0::DOUBLE * count(*))::BIGINT AS n_missing
  FROM orders, (VALUES (10), (15)) r(pct) GROUP BY pct""",
    "a4_discover_scenarios": """SELECT m AS mechanism, m AS folder, count(*) AS n_rows,
  round(sum(o_totalprice), 2) AS total FROM orders, (VALUES ('MAR'), ('MCAR')) v(m) GROUP BY m""",
    "a5_chat_jsonl": """SELECT role, count(*) AS n_records, sum(length(text))::BIGINT AS n_chars
  FROM conversations GROUP BY 1""",
    "a6_append_union": """SELECT o_orderkey,
  CASE WHEN o_orderstatus = 'F' THEN o_custkey END AS o_custkey, o_orderstatus, o_totalprice,
  CASE WHEN o_orderstatus <> 'F' THEN o_orderpriority END AS o_orderpriority FROM orders""",
    "a7_replace_slice": """SELECT o_orderkey, 'Model ' || o_orderpriority AS imputation_method,
  o_totalprice AS mean_rmse FROM orders WHERE NOT starts_with(o_orderpriority, '1-')
  UNION ALL SELECT o_orderkey, 'Model 1-NEW', o_totalprice FROM orders WHERE o_orderkey % 3 = 0""",
    "a8_setting_path": f"""SELECT p_partkey, concat_ws('__', {_token("p_brand")},
  {_token("p_type")}, {_token("p_name")},
  CASE WHEN p_size > 25 THEN {_token("' (v ' || p_size::VARCHAR || ')'")} END) || '.csv'
  AS setting_path FROM part""",
    "b1_coerce_numeric": f"""WITH {_TYPED} SELECT o_orderkey,
  TRY_CAST(trim(mostly) AS DOUBLE) AS mostly, partly, never FROM text""",
    "b1_numeric_share": f"""WITH {_TYPED}
  SELECT 'mostly' AS column_name, round(avg(CASE WHEN TRY_CAST(trim(mostly) AS DOUBLE) IS NOT NULL
    THEN 1.0::DOUBLE ELSE 0 END), 6) AS share FROM text
  UNION ALL SELECT 'partly', round(avg(CASE WHEN TRY_CAST(trim(partly) AS DOUBLE) IS NOT NULL
    THEN 1.0::DOUBLE ELSE 0 END), 6) FROM text
  UNION ALL SELECT 'never', round(avg(CASE WHEN TRY_CAST(trim(never) AS DOUBLE) < 'inf'::DOUBLE
    THEN 1.0::DOUBLE ELSE 0 END), 6) FROM text""",
    "b1_number_literals": f"""SELECT o_orderkey,
  CASE WHEN {sql_unit(7, ORDER_KEYS, "literal")} >= 0.9 THEN o_custkey::DOUBLE END AS code FROM orders""",
    "b2_detect_id_columns": """SELECT 'documents' AS table_name, 'doc_id' AS column_name,
  count(doc_id) AS n, count(DISTINCT doc_id) AS n_distinct FROM documents
  UNION ALL SELECT 'customer', 'c_custkey', count(c_custkey), count(DISTINCT c_custkey) FROM customer""",
    "b9_feature_columns": f"""WITH {_HOLED_LINES} """ + " UNION ALL ".join(
        f"SELECT {i} AS place, '{c}' AS column_name, count({c}) AS n_observed FROM holed"
        for i, c in enumerate(x for x in _ALL_LINE_COLUMNS if x not in (*LINE_KEYS, "l_charge"))),
    "b3_null_profile": f"""WITH {_HOLED_LINES} """ + " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(*) - count({c}) AS null_count, "
        f"round((count(*) - count({c}))::DOUBLE / count(*), 9) AS null_fraction FROM holed"
        for c in _ALL_LINE_COLUMNS),
    "b4_resolve_targets": f"""WITH {_HOLED_LINES}, counted AS ({" UNION ALL ".join(
        f"SELECT '{c}' AS target, {i} AS place, count(*) - count({c}) AS n FROM holed"
        for i, c in enumerate(["l_quantity", "l_extendedprice", "l_charge"]))})
  SELECT 'all_missing_numeric' AS mode, target FROM counted WHERE n > 0
  UNION ALL (SELECT 'primary_missing', target FROM counted WHERE n > 0
             ORDER BY n DESC, place LIMIT 1)""",
    "b5_prepare_pair": """SELECT place, column_name, (SELECT count(*) FROM lineitem) AS n_rows
  FROM (VALUES (0, 'l_quantity'), (1, 'l_extendedprice'), (2, 'l_discount'), (3, 'l_tax'),
               (4, 'l_charge')) v(place, column_name)""",
    "b6_target_summary": f"""WITH {sql_holed_orders()},
  s AS (SELECT min(o_totalprice) AS a, quantile_cont(o_totalprice, 0.25) AS b,
    median(o_totalprice) AS c, quantile_cont(o_totalprice, 0.75) AS d, max(o_totalprice) AS e,
    avg(o_totalprice) AS f FROM holed)
  SELECT k AS statistic, round(v, 4) AS value FROM s, LATERAL (VALUES ('min', a), ('q1', b),
    ('median', c), ('q3', d), ('max', e), ('mean', f)) t(k, v)""",
    "b7_numeric_scales": f"WITH {LINES} " + " UNION ALL ".join(
        f"""SELECT '{c}' AS column_name, round(CASE
  WHEN quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) > 0
  THEN quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)
  WHEN stddev_samp({c}) > 0 THEN stddev_samp({c})
  WHEN abs(median({c})) > 0 THEN abs(median({c})) ELSE 1 END, 6) AS scale FROM lines"""
        for c in ["l_quantity", "l_extendedprice", "l_discount", "l_charge"]),
    "b8_split_observed": f"""WITH {sql_holed_orders()}
  (SELECT 'to_fill' AS part, o_orderkey FROM holed WHERE o_totalprice IS NULL
   ORDER BY o_orderkey LIMIT 25)
  UNION ALL SELECT 'observed', o_orderkey FROM holed WHERE o_totalprice IS NOT NULL""",
}
