"""Similar rows, prompts and chat records."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import texts
from ..operators import folds, inject, matrix, profile, prompts, similar
from ..operators.order import with_position
from ..plans.prompting import training_dataset
from .fixtures import (
    CUSTOMER_KEYS, LINE_KEYS, ORDER_KEYS, customers, lines, load, orders,
    sql_hex, sql_unit)

_TARGET = "c_acctbal"
_FEATURES = ["c_nationkey", "c_mktsegment"]
_HINTS = ["Balances may be negative.", "Nations differ."]


def _holed(spark, sf):
    rows = inject.mcar_column(customers(spark, sf), 0.1, _TARGET, CUSTOMER_KEYS)
    return inject.mcar(rows, 0.05, CUSTOMER_KEYS, 7, ["c_mktsegment"])


def _parts(spark, sf):
    """Holed customers with their observed rows, rows to fill and target summary."""
    holed = _holed(spark, sf)
    observed, open_rows = profile.split_observed(holed, _TARGET)
    return holed, observed, open_rows, profile.target_summary(observed, _TARGET)


def e1_row_similarity(spark, sf):
    rows = customers(spark, sf)
    scales = profile.numeric_scales(rows, ["c_nationkey", "c_acctbal"])
    features = ["c_nationkey", "c_acctbal", "c_mktsegment"]
    left = rows.select("c_custkey", *[F.col(c).alias(f"query_{c}") for c in features])
    right = inject.mcar(rows, 0.2, CUSTOMER_KEYS, 3, features).select(
        (F.col("c_custkey") + 1).alias("c_custkey"),
        *[F.col(c).alias(f"example_{c}") for c in features])
    return left.join(right, "c_custkey").select("c_custkey", F.round(
        similar.row_similarity(features, scales), 9).alias("similarity"))


def _scored(spark, sf):
    rows = customers(spark, sf).withColumn(
        "c_score", F.col("c_acctbal") * 0.5 + F.col("c_nationkey"))
    return inject.mcar(inject.mcar_column(rows, 0.1, "c_score", CUSTOMER_KEYS), 0.05,
                       CUSTOMER_KEYS, 7, ["c_mktsegment"])


def e2_topk_similar(spark, sf):
    holed = _scored(spark, sf)
    observed, open_rows = profile.split_observed(holed, "c_score")
    found = similar.top_similar(
        open_rows, observed, CUSTOMER_KEYS, "c_score",
        ["c_acctbal", "c_nationkey", "c_mktsegment"], 3)
    return found.select("c_custkey", "example_rank", "example_c_custkey",
                        F.round("similarity", 9).alias("similarity"))


def e2_topk_similar_ties(spark, sf):
    _, observed, open_rows, _ = _parts(spark, sf)
    found = similar.top_similar(
        open_rows, observed, CUSTOMER_KEYS, _TARGET, _FEATURES, 2)
    return found.select("c_custkey", "example_rank", "example_c_custkey",
                        F.round("similarity", 9).alias("similarity"))


_WIDE = ["o_totalprice", "o_custkey", "order_year", "order_month", "o_orderstatus", "o_orderpriority",
         "c_acctbal", "c_nationkey", "c_mktsegment"]
_WIDE_NUMBERS = ["o_totalprice", "o_custkey", "order_year", "order_month", "c_acctbal", "c_nationkey"]


def e2_topk_similar_wide(spark, sf):
    """Nine mixed columns with holes: the width of real tables."""
    rows = load(spark, sf, "orders").join(customers(spark, sf), F.col("o_custkey") == F.col("c_custkey")).select(
        "o_orderkey", *[c for c in _WIDE if not c.startswith("order_")],
        F.year("o_orderdate").alias("order_year"), F.month("o_orderdate").alias("order_month"),
        (F.col("o_totalprice") * 0.5 + F.col("c_acctbal")).alias("o_score"))
    holed = inject.mcar(inject.mcar_column(rows, 0.02, "o_score", ORDER_KEYS), 0.05, ORDER_KEYS, 7,
                        ["o_orderpriority", "c_acctbal"])
    observed, open_rows = profile.split_observed(holed, "o_score")
    found = similar.top_similar(open_rows, observed, ORDER_KEYS, "o_score", _WIDE, 3)
    return found.select("o_orderkey", "example_rank", "example_o_orderkey",
                        F.round("similarity", 9).alias("similarity"))


def e3_format_value(spark, sf):
    rows = inject.mcar(lines(spark, sf), 0.1, LINE_KEYS, 42, ["l_quantity", "l_extendedprice"])
    shown = ["l_quantity", "l_extendedprice", "l_discount", "l_returnflag"]
    return rows.select(*LINE_KEYS, *[
        prompts.format_value(c, rows.schema[c].dataType).alias(f"{c}_text") for c in shown])


def e4_feature_text(spark, sf):
    rows = _holed(spark, sf)
    return rows.select("c_custkey", prompts.feature_text(
        rows.schema, [*_FEATURES, _TARGET], _TARGET).alias("feature_text"))


def e5_stats_text(spark, sf):
    _, _, _, summary = _parts(spark, sf)
    return spark.createDataFrame(
        [("summary", prompts.stats_text(summary)), ("guide", prompts.guide_text(summary)),
         ("summary_absent", prompts.stats_text({})), ("guide_absent", prompts.guide_text(None))],
        "kind string, text string")


def e6_build_prompt(spark, sf):
    _, _, open_rows, summary = _parts(spark, sf)
    return open_rows.select("c_custkey", prompts.build_prompt(
        open_rows.schema, _TARGET, _FEATURES, summary, _HINTS).alias("prompt"))


def _flat(df):
    """Messages as one text, which compares the same everywhere."""
    return df.select(*[c for c in df.columns if c != "messages"], F.array_join(F.transform(
        "messages", lambda m: F.concat(m["role"], F.lit("> "), m["content"])), "\n")
        .alias("dialogue"))


def e7_training_messages(spark, sf):
    holed, _, _, summary = _parts(spark, sf)
    return _flat(prompts.training_messages(holed, _TARGET, _FEATURES, CUSTOMER_KEYS, summary))


def e8_inference_messages(spark, sf):
    _, observed, open_rows, summary = _parts(spark, sf)
    examples = similar.top_similar(
        open_rows, observed, CUSTOMER_KEYS, _TARGET, _FEATURES, 2)
    return _flat(prompts.inference_messages(
        open_rows, _TARGET, _FEATURES, CUSTOMER_KEYS, summary, None, examples))


def e9_retry_messages(spark, sf):
    _, _, open_rows, summary = _parts(spark, sf)
    return _flat(prompts.retry_messages(
        open_rows, _TARGET, _FEATURES, CUSTOMER_KEYS, summary, _HINTS))


def e10_legacy_messages(spark, sf):
    holed, _, _, summary = _parts(spark, sf)
    old = prompts.legacy_messages(holed, _TARGET, _FEATURES, CUSTOMER_KEYS)
    new = prompts.inference_messages(holed, _TARGET, _FEATURES, CUSTOMER_KEYS, summary)
    both = old.unionByName(new)
    return _flat(both.select("c_custkey", prompts.prompt_style(F.col("messages")).alias("style"),
                             F.slice("messages", 1, 1).alias("messages")))


def e11_record_prompt(spark, sf):
    _, _, open_rows, summary = _parts(spark, sf)
    return open_rows.select("c_custkey", *[
        prompts.record_prompt(open_rows.schema, "Customer", _TARGET, _FEATURES, summary, _HINTS,
                              retry).alias(name)
        for name, retry in (("prompt", False), ("retry_prompt", True))])


def e12_matrix_prompt(spark, sf):
    placed = matrix.batch_rows(with_position(_holed(spark, sf), CUSTOMER_KEYS), 40)
    columns = ["c_nationkey", "c_acctbal", "c_mktsegment"]
    first = prompts.matrix_prompts(placed, "Customer", columns)
    return first.join(prompts.matrix_prompts(placed, "Customer", columns, retry=True)
                      .select("batch_id", F.col("prompt").alias("retry_prompt")), "batch_id")


def e12_matrix_prompt_plain(spark, sf):
    placed = matrix.batch_rows(with_position(customers(spark, sf), CUSTOMER_KEYS), 40)
    return prompts.matrix_prompts(
        placed, "Customer", ["c_custkey", "c_nationkey", "c_mktsegment"])


def e13_training_dataset(spark, sf):
    rows = orders(spark, sf)
    scenarios = [
        ("orders_mcar", "MCAR", inject.mcar_column(rows, 0.1, "o_totalprice", ORDER_KEYS)),
        ("orders_mar", "MAR", inject.mar(rows, "o_custkey", "o_totalprice", 0.1, ORDER_KEYS)),
        ("orders_full", "MCAR", rows)]
    chats, manifest = training_dataset(spark, scenarios, ORDER_KEYS)
    counted = chats.groupBy("input_table", "mechanism", "target_column").agg(
        F.count(F.lit(1)).alias("n_chats"), F.max(F.size("messages")).alias("n_messages"))
    return manifest.join(counted, ["input_table", "mechanism"], "left").select(
        "input_table", "mechanism", manifest["target_column"], "status", "reason", "n_rows",
        "n_examples", "n_missing_target", "n_observed_target", "n_chats", "n_messages")


def e14_sample_records(spark, sf):
    rows = load(spark, sf, "conversations").select("conv_id", "turn", "role")
    return folds.sample_records(rows, rows.count() // 4, ["conv_id", "turn"])


def e15_batch_rows(spark, sf):
    placed = with_position(orders(spark, sf).select("o_orderkey"), ORDER_KEYS)
    out = matrix.batch_rows(placed, 40, "position", 2, ["o_custkey", "o_totalprice", "o_status"])
    return out.withColumn("block_columns", F.array_join("block_columns", ","))


def _records(spark, sf):
    """Each turn after a fixed question, as a short record."""
    answer = F.concat(F.col("text"), F.lit(" "), (F.col("conv_id") / 4).cast("string"))
    return load(spark, sf, "conversations").select("conv_id", "turn", "role", F.array(
        prompts.message("user", "How many?"),
        F.struct(F.col("role").alias("role"), answer.alias("content"))).alias("messages"))


def e16_assistant_target(spark, sf):
    return _records(spark, sf).select(
        "conv_id", "turn", prompts.assistant_target(F.col("messages")).alias("target"))


def e17_prompt_only(spark, sf):
    closed = _records(spark, sf).where(F.col("role") == "assistant")
    return _flat(closed.select(
        "conv_id", "turn", prompts.prompt_only(F.col("messages")).alias("messages")))


QUERIES = {f.__name__: f for f in (
    e1_row_similarity, e2_topk_similar, e2_topk_similar_ties, e2_topk_similar_wide,
    e3_format_value, e4_feature_text, e5_stats_text, e6_build_prompt, e7_training_messages, e8_inference_messages,
    e9_retry_messages, e10_legacy_messages, e11_record_prompt, e12_matrix_prompt, e12_matrix_prompt_plain,
    e13_training_dataset, e14_sample_records, e15_batch_rows, e16_assistant_target,
    e17_prompt_only)}


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _lines(*parts: str) -> str:
    return "concat_ws(chr(10), " + ", ".join(parts) + ")"


def _number(value: str) -> str:
    body = f"printf('%.6f', {value}::DOUBLE)"
    return (f"coalesce(CASE WHEN {value} IS NOT NULL THEN regexp_replace(regexp_replace({body}, "
            f"'0+$', ''), '\\.$', '') END, 'MISSING')")


def _holes(target: str, column_sql: str) -> str:
    digits = f"md5(concat_ws(':', '42', c_custkey::VARCHAR, '{target}'))"
    segment = sql_unit(7, CUSTOMER_KEYS, "c_mktsegment")
    return f"""holed AS (SELECT c_custkey, c_nationkey, {"c_acctbal, " if target != "c_acctbal" else ""}
    CASE WHEN {segment} >= 0.05::DOUBLE THEN c_mktsegment END AS c_mktsegment,
    CASE WHEN row_number() OVER (ORDER BY {digits}) > floor(0.1::DOUBLE * count(*) OVER ())
      THEN {column_sql} END AS {target} FROM customer)"""


_HOLED = _holes("c_acctbal", "c_acctbal") + """,
  s AS (SELECT min(c_acctbal) AS lo, quantile_cont(c_acctbal, 0.25) AS q1,
    median(c_acctbal) AS q2, quantile_cont(c_acctbal, 0.75) AS q3, max(c_acctbal) AS hi,
    avg(c_acctbal) AS m FROM holed)"""
_STATS = _lines(
    _q(texts.STATS_HEADING), *[f"'- {k}: ' || {_number(v)}" for k, v in zip(
        texts.STATS_ORDER, ("lo", "q1", "q2", "q3", "hi", "m"))])
_GUIDE = _lines(_q(texts.GUIDE_HEADING), *[
    f"'- {label}: ' || {_number({'min': 'lo', 'median': 'q2', 'max': 'hi'}[k])}"
    for label, k in texts.GUIDE_LINES])
_HINT_LINES = _q("\n".join(["", texts.HINT_HEADING, *[f"- {h}" for h in _HINTS]]))


def _features(alias: str = "") -> str:
    return _lines(f"'c_nationkey: ' || {alias}c_nationkey::VARCHAR",
                  f"'c_mktsegment: ' || coalesce({alias}c_mktsegment, 'MISSING')")


def _user(alias: str = "", hints: str | None = None) -> str:
    return _lines(
        _q(texts.USER_OPENING), "''", f"'Target column: {_TARGET}'", _STATS, "''",
        _q(texts.FEATURE_HEADING), _features(alias), *([hints] if hints else []), "''",
        _q(texts.USER_CLOSING))


def _record(retry: bool) -> str:
    body = _lines(
        _q(texts.RECORD_OPENING.format(dataset="Customer", target=_TARGET)), _GUIDE, "''",
        _q(texts.FEATURE_HEADING), _features(), "''", _q(texts.RECORD_RULES), _HINT_LINES, "''",
        _q(texts.RECORD_CLOSING.format(target=_TARGET)))
    return f"{body} || {_q(texts.RECORD_RETRY)}" if retry else body


def _similarity(features: list[str], numeric: list[str], q: str = "q", e: str = "e") -> str:
    parts, used = [], []
    for c in features:
        both = f"{q}.{c} IS NOT NULL AND {e}.{c} IS NOT NULL"
        if c in numeric:
            value = f"1 / (1 + abs({q}.{c} - {e}.{c})::DOUBLE / {c}_scale)"
        else:
            value = f"CASE WHEN {q}.{c} = {e}.{c} THEN 1.0::DOUBLE ELSE 0 END"
        parts.append(f"CASE WHEN {both} THEN {value} ELSE 0.0::DOUBLE END")
        used.append(f"CASE WHEN {both} THEN 1.0::DOUBLE ELSE 0 END")
    total, n = " + ".join(parts), " + ".join(used)
    return f"CASE WHEN {n} > 0 THEN ({total}) / ({n}) END"


def _scales(numeric: list[str], table: str) -> str:
    """IQR; the given columns all have one above zero."""
    return ", ".join(f"(SELECT quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) FROM {table}) "
                     f"AS {c}_scale" for c in numeric)


def _top(target: str, features: list[str], numeric: list[str], k: int, key: str = "c_custkey") -> str:
    return f"""observed AS (SELECT * FROM holed WHERE {target} IS NOT NULL),
  scales AS (SELECT {_scales(numeric, "observed")}),
  pairs AS (SELECT q.{key}, e.{key} AS example_{key},
    {_similarity(features, numeric)} AS similarity FROM holed q, observed e, scales
    WHERE q.{target} IS NULL),
  top AS (SELECT *, row_number() OVER (PARTITION BY {key}
    ORDER BY similarity DESC, example_{key})::INTEGER AS example_rank FROM pairs
    WHERE similarity IS NOT NULL QUALIFY example_rank <= {k})"""


_MATRIX_COLUMNS = ["c_custkey", "c_nationkey", "c_mktsegment"]


def _laid_out(cells: list[str]) -> str:
    """Cells right-aligned to the width of their column, one space apart."""
    return " || ' ' || ".join(
        f"lpad({cell}, w_{c}, ' ')" for c, cell in zip(_MATRIX_COLUMNS, cells))


def _width(c: str) -> str:
    """Values have a sign place in front, headers only over numbers."""
    head = len(c) + (c != "c_mktsegment")
    return (f"greatest({head}, 1 + max(length({c}::VARCHAR)) OVER (PARTITION BY batch_id))::INTEGER "
            f"AS w_{c}")


def _matrix_text() -> str:
    head, rest = texts.MATRIX_PROMPT.format(
        dataset="Customer", matrix="@", header=", ".join(_MATRIX_COLUMNS), n_columns=3,
        n_commas=2, n_rows="#").split("@")
    above, below = rest.split("#")
    return f"{_q(head)} || matrix || {_q(above)} || n_rows::VARCHAR || {_q(below)}"


_TOP_RESULT = ("SELECT c_custkey, example_rank, example_c_custkey, "
               "round(similarity, 9) AS similarity FROM top")
_E1 = ["c_nationkey", "c_acctbal", "c_mktsegment"]
_LK = ", ".join(LINE_KEYS)
_ANSWER = "(text || ' ' || (conv_id / 4.0::DOUBLE)::VARCHAR)"

SQL = {
    "e1_row_similarity": f"""WITH scales AS (SELECT {_scales(_E1[:2], "customer")}),
  e AS (SELECT c_custkey + 1 AS k, {", ".join(
      f"CASE WHEN {sql_unit(3, CUSTOMER_KEYS, c)} >= 0.2::DOUBLE THEN {c} END AS {c}"
      for c in _E1)} FROM customer)
  SELECT q.c_custkey, round({_similarity(_E1, _E1[:2])}, 9) AS similarity
  FROM customer q JOIN e ON e.k = q.c_custkey, scales""",
    "e2_topk_similar": f"""WITH {_holes("c_score", "c_acctbal * 0.5::DOUBLE + c_nationkey")},
  {_top("c_score", ["c_acctbal", "c_nationkey", "c_mktsegment"], ["c_acctbal", "c_nationkey"], 3)}
  {_TOP_RESULT}""",
    "e2_topk_similar_ties": f"""WITH {_HOLED}, {_top(_TARGET, _FEATURES, ["c_nationkey"], 2)}
  {_TOP_RESULT}""",
    "e2_topk_similar_wide": f"""WITH scored AS (SELECT o_orderkey, o_totalprice, o_custkey,
    year(o_orderdate) AS order_year, month(o_orderdate) AS order_month, o_orderstatus,
    CASE WHEN {sql_unit(7, ORDER_KEYS, "o_orderpriority")} >= 0.05::DOUBLE THEN o_orderpriority END AS o_orderpriority,
    CASE WHEN {sql_unit(7, ORDER_KEYS, "c_acctbal")} >= 0.05::DOUBLE THEN c_acctbal END AS c_acctbal,
    c_nationkey, c_mktsegment, o_totalprice * 0.5::DOUBLE + c_acctbal AS score
    FROM orders JOIN customer ON o_custkey = c_custkey),
  holed AS (SELECT *, CASE WHEN row_number() OVER (ORDER BY {sql_hex(42, ORDER_KEYS, "'o_score'")})
    > floor(0.02::DOUBLE * count(*) OVER ()) THEN score END AS o_score FROM scored),
  {_top("o_score", _WIDE, _WIDE_NUMBERS, 3, "o_orderkey")}
  SELECT o_orderkey, example_rank, example_o_orderkey, round(similarity, 9) AS similarity FROM top""",
    "e3_format_value": f"""SELECT {_LK}, {", ".join(
        f"{_number(f'(CASE WHEN {sql_unit(42, LINE_KEYS, c)} >= 0.1::DOUBLE THEN {c} END)')} "
        f"AS {c}_text" for c in ("l_quantity", "l_extendedprice"))},
  {_number("l_discount")} AS l_discount_text, l_returnflag AS l_returnflag_text FROM lineitem""",
    "e4_feature_text": f"WITH {_HOLED} SELECT c_custkey, {_features()} AS feature_text FROM holed",
    "e5_stats_text": f"""WITH {_HOLED} SELECT 'summary' AS kind, {_STATS} AS text FROM s
  UNION ALL SELECT 'guide', {_GUIDE} FROM s
  UNION ALL SELECT 'summary_absent', {_q(texts.STATS_ABSENT)}
  UNION ALL SELECT 'guide_absent', {_q(texts.GUIDE_ABSENT)}""",
    "e6_build_prompt": f"""WITH {_HOLED} SELECT c_custkey, {_q(texts.SYSTEM)} || chr(10) || chr(10)
    || {_user(hints=_HINT_LINES)} AS prompt FROM holed, s WHERE c_acctbal IS NULL""",
    "e7_training_messages": f"""WITH {_HOLED} SELECT c_custkey, {_lines(
        "'system> ' || " + _q(texts.SYSTEM), "'user> ' || " + _user(),
        "'assistant> ' || " + _number("c_acctbal"))} AS dialogue
  FROM holed, s WHERE c_acctbal IS NOT NULL""",
    "e8_inference_messages": f"""WITH {_HOLED}, {_top(_TARGET, _FEATURES, ["c_nationkey"], 2)},
  demos AS (SELECT top.c_custkey, string_agg({_lines(
      "'user> ' || " + _user("h."), "'assistant> ' || " + _number("h.c_acctbal"))}, chr(10)
      ORDER BY example_rank) AS shown
    FROM top JOIN holed h ON h.c_custkey = example_c_custkey, s GROUP BY 1)
  SELECT h.c_custkey, {_lines("'system> ' || " + _q(texts.SYSTEM), "shown",
                              "'user> ' || " + _user("h."))} AS dialogue
  FROM s, holed h LEFT JOIN demos ON demos.c_custkey = h.c_custkey WHERE h.c_acctbal IS NULL""",
    "e9_retry_messages": f"""WITH {_HOLED} SELECT c_custkey, {_lines(
        "'system> ' || " + _q(texts.RETRY_SYSTEM), "'user> ' || " + _lines(
            f"'Target column: {_TARGET}'", _STATS, _q(texts.FEATURE_HEADING), _features(),
            _HINT_LINES, "''", _q(texts.RETRY_CLOSING)))} AS dialogue
  FROM holed, s WHERE c_acctbal IS NULL""",
    "e10_legacy_messages": f"""SELECT c_custkey, style, 'system> ' || text AS dialogue
  FROM customer, (VALUES ('legacy', {_q(texts.LEGACY_SYSTEM)}),
                         ('current', {_q(texts.SYSTEM)})) v(style, text)""",
    "e11_record_prompt": f"""WITH {_HOLED} SELECT c_custkey, {_record(False)} AS prompt,
  {_record(True)} AS retry_prompt FROM holed, s WHERE c_acctbal IS NULL""",
    "e12_matrix_prompt_plain": f"""WITH p AS (SELECT *, row_number() OVER (ORDER BY c_custkey) - 1
    AS position FROM customer),
  b AS (SELECT *, position // 40 AS batch_id, (position % 40)::VARCHAR AS i FROM p),
  w AS (SELECT *, {", ".join(_width(c) for c in _MATRIX_COLUMNS)}, max(length(i)) OVER (PARTITION BY batch_id)::INTEGER AS w_i FROM b),
  m AS (SELECT batch_id, count(*) AS n_rows,
    repeat(' ', max(w_i)) || ' ' || any_value({_laid_out([_q(c) for c in _MATRIX_COLUMNS])})
    || chr(10) || string_agg(rpad(i, w_i, ' ') || ' ' ||
      {_laid_out([f"{c}::VARCHAR" for c in _MATRIX_COLUMNS])}, chr(10) ORDER BY position) AS matrix
    FROM w GROUP BY 1)
  SELECT batch_id, n_rows, {_matrix_text()} AS prompt FROM m""",
    "e13_training_dataset": """WITH c AS (SELECT count(*) AS n FROM orders), k AS (
    SELECT 'orders_mcar' AS input_table, 'MCAR' AS mechanism, n,
      floor(0.1::DOUBLE * n)::BIGINT AS k FROM c
    UNION ALL SELECT 'orders_mar', 'MAR', n, round_even(0.1::DOUBLE * n, 0)::BIGINT FROM c)
  SELECT input_table, mechanism, 'o_totalprice' AS target_column, 'prepared' AS status,
    NULL::VARCHAR AS reason, n AS n_rows, n - k AS n_examples, k AS n_missing_target,
    n - k AS n_observed_target, n - k AS n_chats, 3 AS n_messages FROM k
  UNION ALL SELECT 'orders_full', 'MCAR', NULL, 'skipped', 'no_numeric_missing_target_found', n,
    0, NULL, NULL, NULL, NULL FROM c""",
    "e14_sample_records": f"""SELECT conv_id, turn, role, sample_position FROM (
  SELECT conv_id, turn, role, row_number() OVER (ORDER BY
    {sql_unit(42, ["conv_id", "turn"], "sample")}) - 1 AS sample_position FROM conversations)
  WHERE sample_position < (SELECT count(*) // 4 FROM conversations)""",
    "e15_batch_rows": """WITH p AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1
    AS position FROM orders)
  SELECT o_orderkey, position, position // 40 AS batch_id, position % 40 AS row_in_batch,
    col_block, block_columns FROM p,
  (VALUES (0, 'o_custkey,o_totalprice'), (1, 'o_status')) b(col_block, block_columns)""",
    "e16_assistant_target": f"""SELECT conv_id, turn, CASE WHEN role = 'assistant' THEN TRY_CAST(
  regexp_extract({_ANSWER}, '[-+]?\\d*\\.?\\d+') AS DOUBLE) END AS target FROM conversations""",
    "e17_prompt_only": """SELECT conv_id, turn, 'user> How many?' AS dialogue
  FROM conversations WHERE role = 'assistant'""",
}
