"""Model answers."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ..functions.hashing import row_unit
from ..operators import answers, inject, matrix
from ..operators.order import with_position
from ..plans.prompting import evaluate_answers, impute_by_matrix
from .fixtures import (
    CUSTOMER_KEYS, ORDER_KEYS, customers, load, orders, sql_unit)

_CASES = 14


def _case(salt: str):
    return F.floor(row_unit(5, ORDER_KEYS, salt) * _CASES)


def _response(salt: str):
    """Answers as models give them: plain, worded, fenced, with separators, empty, useless."""
    a = F.floor("o_totalprice").cast("string")
    b = F.col("o_custkey").cast("string")
    tail = F.lpad((F.col("o_custkey") % 1000).cast("string"), 3, "0")
    forms = [
        a, F.concat(F.lit(" "), a, F.lit(".5 ")), F.concat(F.lit("Answer: -"), a, F.lit(".25")),
        F.lit(".5"), F.concat(b, F.lit(","), tail, F.lit(".56")),
        F.concat(b, F.lit("."), tail, F.lit(",56")), F.concat(b, F.lit(",45")), F.lit("1e3"),
        F.concat(F.lit("```text\n7\n``` or ```\n"), a, F.lit("\n```")), F.lit(""),
        F.lit(None).cast("string"), F.lit("n/a"),
        F.concat(F.lit("it's \"about\"\n"), b, F.lit(" or so")), F.lit("I don't know"),
    ]
    case = _case(salt)
    out = F.when(case == 0, forms[0])
    for i, form in enumerate(forms[1:], start=1):
        out = out.when(case == i, form)
    return out


def _answered(spark, sf):
    return orders(spark, sf).select(
        "o_orderkey", "o_totalprice", _response("first").alias("first_raw"),
        _response("retry").alias("retry_raw"))


def f1_first_number(spark, sf):
    return _answered(spark, sf).select(
        "o_orderkey", answers.first_number(F.col("first_raw")).alias("value"))


def f1_first_number_documents(spark, sf):
    return load(spark, sf, "documents").select(
        "doc_id", answers.first_number(F.col("text")).alias("value"))


def f2_numeric_value(spark, sf):
    return _answered(spark, sf).select(
        "o_orderkey", answers.numeric_value(F.col("first_raw")).alias("value"))


_FORMS = 7


def _tables(spark, sf):
    """One small table per order as a model might return it, in seven layouts."""
    cells = ["o_orderkey", "o_custkey", "o_orderstatus"]

    def row(sep: str, *values):
        return F.concat_ws(sep, *[v if not isinstance(v, str) else F.lit(v) for v in values])

    k, c, s = (F.col(x).cast("string") for x in cells)
    two = [(k, c, s), (c, k, F.lit("Z"))]

    def table(sep: str, header: bool = True, order=(0, 1, 2)):
        lines_ = ([row(sep, *[cells[i] for i in order])] if header else []) + [
            row(sep, *[r[i] for i in order]) for r in two]
        return F.concat_ws("\n", *lines_)

    piped = F.concat_ws("\n", F.lit("| o_orderkey | o_custkey | o_orderstatus |"),
                        F.lit("|---|:---:|---|"), *[
        F.concat(F.lit("| "), row(" | ", *r), F.lit(" |")) for r in two])
    indexed = F.concat_ws("\n", F.lit(",o_orderkey,o_custkey,o_orderstatus"), *[
        F.concat(F.lit(f"{i},"), row(",", *r)) for i, r in enumerate(two)])
    forms = [
        table(","), F.concat(F.lit("Here it is:\n```csv\n"), table(";"), F.lit("\n```\nDone.")),
        table("\t", order=(2, 0, 1)), piped, indexed, table(" ", header=False),
        F.concat_ws("\n", row(",", *cells), row(",", *two[0]), row(",", *two[0]),
                    row(",", *two[1]))]
    case = F.floor(row_unit(9, ORDER_KEYS, "layout") * _FORMS)
    text = F.when(case == 0, forms[0])
    for i, form in enumerate(forms[1:], start=1):
        text = text.when(case == i, form)
    return orders(spark, sf).select(
        F.col("o_orderkey").alias("batch_id"), case.alias("layout"),
        F.lit(2).cast("long").alias("n_rows"), text.alias("response"))


_CELLS = ["o_orderkey", "o_custkey", "o_orderstatus"]


def f3_parse_matrix(spark, sf):
    parsed = matrix.parse_matrix_responses(_tables(spark, sf), 3)
    return parsed.select("batch_id", F.size("parsed.body").alias("n_parsed"),
                         F.col("parsed.error").alias("parse_error"),
                         F.array_join("parsed.header", ",").alias("header"))


def f4_align_matrix(spark, sf):
    parsed = matrix.parse_matrix_responses(_tables(spark, sf), 3)
    return matrix.explode_aligned(matrix.align_matrix(parsed, _CELLS), _CELLS)


def f5_recover_partial_rows(spark, sf):
    placed = matrix.batch_rows(with_position(
        orders(spark, sf).select("o_orderkey", "o_custkey"), ORDER_KEYS), 10)
    # Every answer stops after its first seven rows.
    told = placed.where(F.col("row_in_batch") < 7).select(
        "batch_id", "row_in_batch", (F.col("o_custkey") + 1).cast("string").alias("o_custkey"))
    return matrix.recover_partial_rows(placed, told, ["o_custkey"]).select(
        "o_orderkey", "batch_id", "row_in_batch", "o_custkey", "answered")


def f6_resolve_answers(spark, sf):
    rows = _answered(spark, sf).withColumns({
        "fallback_value": F.round(F.col("o_totalprice") / 2, 6),
        "fallback_source": F.lit("fallback_median")})
    return answers.resolve_answers(rows).select(
        "o_orderkey", "prediction", "source", "raw_output")


def f7_split_failed_batches(spark, sf):
    placed = matrix.batch_rows(with_position(
        orders(spark, sf).select("o_orderkey"), ORDER_KEYS), 40)
    blocks = placed.groupBy("batch_id").agg(
        F.min("position").alias("row_start"), (F.max("position") + 1).alias("row_end"))
    failed = row_unit(3, ["batch_id"], "failed") < 0.3
    kept, halves = matrix.split_failed_batches(blocks, failed)
    return kept.select(F.lit("kept").alias("part"), "row_start", "row_end").unionByName(
        halves.select(F.lit("half").alias("part"), "row_start", "row_end"))


def _block(spark, sf):
    """Answered cells for some of the orders, some of them not numbers."""
    u = row_unit(11, ORDER_KEYS, "block")
    return orders(spark, sf).where(u < 0.4).select(
        "o_orderkey", F.when(u < 0.05, F.lit("unknown")).otherwise(
            (F.col("o_custkey") * 2).cast("string")).alias("o_custkey"),
        F.lower("o_orderpriority").alias("o_orderpriority"))


def f8_write_back(spark, sf):
    return matrix.write_back(orders(spark, sf), _block(spark, sf), ORDER_KEYS,
                             ["o_custkey", "o_orderpriority"])


def f8_added_nulls(spark, sf):
    return matrix.added_nulls(_block(spark, sf), ["o_custkey"])


def f9_summarise_notes(spark, sf):
    notes = F.split(F.regexp_replace("p_name", " ", "|"), r"\|")
    several = F.concat(notes, F.array(F.col("p_brand"), F.col("p_type"), F.lit(""), F.col("p_brand"),
                                      F.lit(None).cast("string"),
                                      F.col("p_size").cast("string")))
    return load(spark, sf, "part").select(
        "p_partkey", answers.summarise_notes(several, 4).alias("notes"))


def _count_letters(prompts: list) -> list:
    return [str(len(p)) for p in prompts]


def f10_score_with_model(spark, sf):
    rows = orders(spark, sf).select(
        "o_orderkey", F.repeat(F.lit("x"), F.length("o_orderpriority")).alias("prompt"))
    return answers.score_with_model(rows, _count_letters, "prompt").select("o_orderkey", "answer")


def _echo_nation(prompts: list) -> list:
    """Stand-in for a model: answers with the nation, and not at all for every third length."""
    out = []
    for p in prompts:
        last = json.loads(p)[-1]["content"]
        nation = last.split("c_nationkey: ")[1].split("\n")[0]
        strict = last.endswith("Answer:")
        out.append("no idea" if len(nation) == 1 and not strict else f"{nation}00")
    return out


def _open_customers(spark, sf):
    return inject.mcar_column(customers(spark, sf), 0.1, "c_acctbal", CUSTOMER_KEYS)


def h11_evaluate_answers(spark, sf):
    detail, _ = evaluate_answers(
        customers(spark, sf), _open_customers(spark, sf), CUSTOMER_KEYS, "c_acctbal",
        ["c_nationkey", "c_mktsegment"], _echo_nation)
    return detail.select("c_custkey", "prediction", "ground_truth",
                         F.round("abs_error", 6).alias("abs_error"), "source", "raw_output")


def h11_evaluate_answers_fewshot(spark, sf):
    _, summary = evaluate_answers(
        customers(spark, sf), _open_customers(spark, sf), CUSTOMER_KEYS, "c_acctbal",
        ["c_nationkey", "c_mktsegment"], _echo_nation, few_shot_k=2)
    return summary.select("n_valid", F.round("mean_rmse", 4).alias("mean_rmse"),
                          F.round("mean_nrmse", 8).alias("mean_nrmse"),
                          F.round("fallback_rate", 9).alias("fallback_rate"))


def _complete_table(prompts: list) -> list:
    """Stand-in for a model: returns the table with 100 * nation in each hole."""
    out = []
    for p in prompts:
        text = p.split("Matrix:\n    ")[1].split("\n\n    Output Format")[0]
        head, *rows = text.split("\n")
        body = []
        for r in rows:
            _, nation, balance, segment = r.split()
            body.append(",".join([nation, str(int(nation) * 100) if balance == "NaN" else balance,
                                  segment]))
        # Too many rows at once: no table, so the block has to be halved.
        table = "\n".join([",".join(head.split()), *body])
        out.append(table if len(rows) <= 30 else "The table is too long.")
    return out


def f11_impute_by_matrix(spark, sf):
    detail, _ = impute_by_matrix(
        customers(spark, sf), _open_customers(spark, sf), CUSTOMER_KEYS, "c_acctbal",
        ["c_nationkey", "c_acctbal", "c_mktsegment"], _complete_table, "Customer", n_rows=None)
    return detail.select("c_custkey", "prompt_row_position", "fold_id", "prediction",
                         "ground_truth", "source")


def f11_impute_by_matrix_folds(spark, sf):
    detail, _ = impute_by_matrix(
        customers(spark, sf), _open_customers(spark, sf), CUSTOMER_KEYS, "c_acctbal",
        ["c_nationkey", "c_acctbal", "c_mktsegment"], _complete_table, "Customer", n_rows=None,
        n_folds=2)
    return detail.select("c_custkey", "fold_id", "prediction", "source")


def _complete_narrow_table(prompts: list) -> list:
    """Stand-in for a model that sees two columns: 100 * nation in each hole, and no use of nation 7 or of segments."""
    out = []
    for p in prompts:
        text = p.split("Matrix:\n    ")[1].split("\n\n    Output Format")[0]
        head, *rows = text.split("\n")
        cells = [r.split()[1:] for r in rows]
        if "c_acctbal" not in head:
            out.append("\n".join([",".join(head.split()), *[",".join(c) for c in cells]]))
            continue
        body = [",".join([n, "?" if b == "NaN" and n == "7" else str(int(n) * 100) if b == "NaN" else b]) for n, b in cells]
        out.append("\n".join([",".join(head.split()), *body]))
    return out


def f11_impute_by_matrix_blocks(spark, sf):
    """Blocks of two columns; a row that is never answered halves its blocks down to itself and leaves its notes."""
    detail, _ = impute_by_matrix(
        customers(spark, sf), _open_customers(spark, sf), CUSTOMER_KEYS, "c_acctbal",
        ["c_nationkey", "c_acctbal", "c_mktsegment", "c_custkey"], _complete_narrow_table, "Customer", batch_row=4,
        batch_col=2)
    notes = F.split("notes", r" \| ")
    return detail.select(
        "c_custkey", "source", "error", F.get(notes, 0).alias("first_note"),
        F.when(F.col("error").isNotNull(), F.get(notes, 1)).alias("second_note"),
        F.when(F.col("source") == "paper_prompt", F.col("prediction")).alias("prediction"))


QUERIES = {f.__name__: f for f in (
    f1_first_number, f1_first_number_documents, f2_numeric_value, f3_parse_matrix,
    f4_align_matrix, f5_recover_partial_rows, f6_resolve_answers, f7_split_failed_batches,
    f8_write_back, f8_added_nulls, f9_summarise_notes, f10_score_with_model,
    f11_impute_by_matrix, f11_impute_by_matrix_folds, f11_impute_by_matrix_blocks, h11_evaluate_answers,
    h11_evaluate_answers_fewshot)}


def _sql_response(salt: str) -> str:
    a = "floor(o_totalprice)::BIGINT::VARCHAR"
    b = "o_custkey::VARCHAR"
    tail = "lpad((o_custkey % 1000)::VARCHAR, 3, '0')"
    forms = [
        a, f"' ' || {a} || '.5 '", f"'Answer: -' || {a} || '.25'", "'.5'",
        f"{b} || ',' || {tail} || '.56'", f"{b} || '.' || {tail} || ',56'", f"{b} || ',45'",
        "'1e3'", f"'```text' || chr(10) || '7' || chr(10) || '``` or ```' || chr(10) || {a} "
                 "|| chr(10) || '```'", "''", "NULL", "'n/a'",
        f"'it''s \"about\"' || chr(10) || {b} || ' or so'", "'I don''t know'"]
    return ("CASE floor(" + sql_unit(5, ORDER_KEYS, salt) + f" * {_CASES}) " + " ".join(
        f"WHEN {i} THEN {form}" for i, form in enumerate(forms)) + " END")


_ANSWERED = f"""answered AS (SELECT o_orderkey, o_totalprice,
  {_sql_response("first")} AS first_raw, {_sql_response("retry")} AS retry_raw FROM orders)"""


def _first(text: str) -> str:
    return f"TRY_CAST(nullif(regexp_extract({text}, '[-+]?\\d*\\.?\\d+'), '') AS DOUBLE)"


def _separator(token: str) -> str:
    comma_last = (f"instr(reverse({token}), ',') < instr(reverse({token}), '.')")
    return (f"CASE WHEN contains({token}, ',') AND contains({token}, '.') AND {comma_last} "
            f"THEN replace(replace({token}, '.', ''), ',', '.') "
            f"WHEN contains({token}, ',') AND contains({token}, '.') THEN replace({token}, ',', '') "
            f"ELSE replace({token}, ',', '.') END")


def _quoted(text: str) -> str:
    body = f"replace(replace({text}, '\\', '\\\\'), chr(10), '\\n')"
    return (f"coalesce(CASE WHEN contains({text}, '''') AND NOT contains({text}, '\"') "
            f"THEN '\"' || {body} || '\"' ELSE '''' || replace({body}, '''', '\\''') || '''' END, "
            "'None')")


_PLAIN = "'^[-+]?(\\d+\\.?\\d*|\\.\\d+)([eE][-+]?\\d+)?$'"
_TOKEN = "'[-+]?\\d+(?:[.,]\\d+)?(?:[eE][-+]?\\d+)?'"
_OPEN = f"""holed AS (SELECT c_custkey, c_nationkey, c_mktsegment, c_acctbal AS truth,
  CASE WHEN row_number() OVER (ORDER BY md5(concat_ws(':', '42', c_custkey::VARCHAR, 'c_acctbal')))
    > floor(0.1::DOUBLE * count(*) OVER ()) THEN c_acctbal END AS c_acctbal FROM customer)"""
_LAYOUT = "floor(" + sql_unit(9, ORDER_KEYS, "layout") + f" * {_FORMS})"
_ANSWER_TEXT = "c_nationkey::VARCHAR || '00'"
_ECHO = f"""{_OPEN}, told AS (SELECT c_custkey, (c_nationkey * 100)::DOUBLE AS prediction,
  truth AS ground_truth, round(abs(c_nationkey * 100 - truth), 6) AS abs_error,
  CASE WHEN c_nationkey < 10 THEN 'model_retry' ELSE 'model_first_try' END AS source,
  {_ANSWER_TEXT} AS raw_output FROM holed WHERE c_acctbal IS NULL)"""

SQL = {
    "f1_first_number": f"WITH {_ANSWERED} SELECT o_orderkey, {_first('first_raw')} AS value "
                       "FROM answered",
    "f1_first_number_documents": f"SELECT doc_id, {_first('text')} AS value FROM documents",
    "f2_numeric_value": f"""WITH {_ANSWERED},
  blocks AS (SELECT o_orderkey, first_raw, regexp_extract_all(first_raw,
    '```(?:text|csv)?\\s*(.*?)\\s*```', 1, 's') AS b FROM answered),
  content AS (SELECT o_orderkey, regexp_replace(CASE WHEN len(b) = 0 THEN first_raw
    WHEN len(b) = 1 OR length(b[1]) >= length(b[2]) THEN b[1] ELSE b[2] END,
    '^\\s+|\\s+$', '', 'g') AS c FROM blocks),
  parts AS (SELECT o_orderkey, {_separator("c")} AS whole,
    {_separator("regexp_replace(split_part(c, chr(10), 1), '^\\s+|\\s+$', '', 'g')")} AS line,
    {_separator(f"nullif(regexp_extract(c, {_TOKEN}), '')")} AS token FROM content)
  SELECT o_orderkey, coalesce(
    CASE WHEN regexp_matches(whole, {_PLAIN}) THEN TRY_CAST(whole AS DOUBLE) END,
    CASE WHEN regexp_matches(line, {_PLAIN}) THEN TRY_CAST(line AS DOUBLE) END,
    TRY_CAST(token AS DOUBLE)) AS value FROM parts""",
    "f3_parse_matrix": f"""SELECT o_orderkey AS batch_id, CASE {_LAYOUT} WHEN 6 THEN 3 ELSE 2 END
    AS n_parsed, NULL::VARCHAR AS parse_error, CASE {_LAYOUT}
      WHEN 2 THEN 'o_orderstatus,o_orderkey,o_custkey' WHEN 4 THEN ',o_orderkey,o_custkey,o_orderstatus'
      WHEN 5 THEN NULL ELSE 'o_orderkey,o_custkey,o_orderstatus' END AS header FROM orders""",
    "f4_align_matrix": f"""WITH o AS (SELECT *, {_LAYOUT} AS layout FROM orders)
  SELECT o_orderkey AS batch_id, row_in_batch, CASE WHEN row_in_batch = 0 THEN o_orderkey
      ELSE o_custkey END::VARCHAR AS o_orderkey, CASE WHEN row_in_batch = 0 THEN o_custkey
      ELSE o_orderkey END::VARCHAR AS o_custkey,
    CASE WHEN row_in_batch = 0 THEN o_orderstatus ELSE 'Z' END AS o_orderstatus
  FROM o, (VALUES (0::BIGINT), (1)) r(row_in_batch)""",
    "f5_recover_partial_rows": """WITH p AS (SELECT o_orderkey, o_custkey,
    row_number() OVER (ORDER BY o_orderkey) - 1 AS position FROM orders)
  SELECT o_orderkey, position // 10 AS batch_id, position % 10 AS row_in_batch,
    (CASE WHEN position % 10 < 7 THEN o_custkey + 1 ELSE o_custkey END)::VARCHAR AS o_custkey,
    position % 10 < 7 AS answered FROM p""",
    "f6_resolve_answers": f"""WITH {_ANSWERED}, n AS (SELECT *, {_first("first_raw")} AS one,
    {_first("retry_raw")} AS two FROM answered)
  SELECT o_orderkey, coalesce(one, two, round(o_totalprice / 2, 6)) AS prediction,
    CASE WHEN one IS NOT NULL THEN 'model_first_try' WHEN two IS NOT NULL THEN 'model_retry'
      ELSE 'fallback_median' END AS source,
    CASE WHEN one IS NOT NULL THEN first_raw WHEN two IS NOT NULL THEN retry_raw
      ELSE 'first_try=' || {_quoted("first_raw")} || ' | retry=' || {_quoted("retry_raw")} END
      AS raw_output FROM n""",
    "f7_split_failed_batches": f"""WITH p AS (SELECT row_number() OVER (ORDER BY o_orderkey) - 1
    AS position FROM orders),
  b AS (SELECT position // 40 AS batch_id, min(position) AS lo, max(position) + 1 AS hi
    FROM p GROUP BY 1),
  m AS (SELECT *, lo + (hi - lo) // 2 AS mid, {sql_unit(3, ["batch_id"], "failed")} < 0.3::DOUBLE
    AND hi - lo > 1 AS again FROM b)
  SELECT 'kept' AS part, lo AS row_start, hi AS row_end FROM m WHERE NOT again
  UNION ALL SELECT 'half', lo, mid FROM m WHERE again
  UNION ALL SELECT 'half', mid, hi FROM m WHERE again""",
    "f8_write_back": f"""WITH u AS (SELECT *, {sql_unit(11, ORDER_KEYS, "block")} AS u FROM orders)
  SELECT o_orderkey, CASE WHEN u < 0.05 THEN NULL WHEN u < 0.4 THEN o_custkey * 2
      ELSE o_custkey END AS o_custkey, o_orderstatus, o_totalprice,
    CASE WHEN u < 0.4 THEN lower(o_orderpriority) ELSE o_orderpriority END AS o_orderpriority
  FROM u""",
    "f8_added_nulls": f"""SELECT 'o_custkey' AS column_name, count(*) AS added_nulls FROM orders
  WHERE {sql_unit(11, ORDER_KEYS, "block")} < 0.05::DOUBLE""",
    "f9_summarise_notes": """WITH n AS (SELECT p_partkey, i, note, min(i) OVER
      (PARTITION BY p_partkey, note) AS first_i FROM (SELECT p_partkey,
      unnest(list_concat(string_split(p_name, ' '),
        [p_brand, p_type, '', p_brand, NULL, p_size::VARCHAR])) AS note,
      unnest(range(len(string_split(p_name, ' ')) + 6)) AS i FROM part)
    WHERE note IS NOT NULL AND note <> ''),
  d AS (SELECT p_partkey, note, row_number() OVER (PARTITION BY p_partkey ORDER BY i) AS r,
    count(*) OVER (PARTITION BY p_partkey) AS c FROM n WHERE i = first_i)
  SELECT p_partkey, string_agg(note, ' | ' ORDER BY r) FILTER (r <= 4) || CASE WHEN max(c) > 4
    THEN ' | ... (+' || (max(c) - 4)::VARCHAR || ' more)' ELSE '' END AS notes
  FROM d GROUP BY 1""",
    "f10_score_with_model": """SELECT o_orderkey, length(o_orderpriority)::VARCHAR AS answer
  FROM orders""",
    "f11_impute_by_matrix": f"""WITH {_OPEN}, p AS (SELECT *, row_number() OVER (ORDER BY c_custkey)
    - 1 AS position FROM holed)
  SELECT c_custkey, position AS prompt_row_position, 1 AS fold_id,
    (c_nationkey * 100)::DOUBLE AS prediction, truth AS ground_truth, 'paper_prompt' AS source
  FROM p WHERE c_acctbal IS NULL""",
    "f11_impute_by_matrix_folds": f"""WITH {_OPEN}
  SELECT c_custkey, ntile(2) OVER (ORDER BY c_custkey)::INTEGER AS fold_id,
    (c_nationkey * 100)::DOUBLE AS prediction, 'paper_prompt_fold' AS source
  FROM holed WHERE c_acctbal IS NULL""",
    "f11_impute_by_matrix_blocks": f"""WITH {_OPEN}, p AS (SELECT *, row_number() OVER (ORDER BY c_custkey)
    - 1 AS position, count(*) OVER () AS n FROM holed),
  b AS (SELECT *, position // 4 * 4 AS low, least(position // 4 * 4 + 4, n) AS high,
    count(*) FILTER (c_acctbal IS NULL AND c_nationkey = 7) OVER (PARTITION BY position // 4) AS n_open FROM p)
  SELECT c_custkey, CASE WHEN c_nationkey = 7 THEN 'fallback_median' ELSE 'paper_prompt' END AS source,
    CASE WHEN c_nationkey = 7 THEN 'r' || position || '-' || position + 1 || ':target_open(1)' END AS error,
    'column_blocks(2/4)' AS first_note, CASE WHEN c_nationkey = 7 THEN 'r' || low || '-' || high || ':target_open('
      || n_open || ')' END AS second_note,
    CASE WHEN c_nationkey <> 7 THEN (c_nationkey * 100)::DOUBLE END AS prediction
  FROM b WHERE c_acctbal IS NULL""",
    "h11_evaluate_answers": f"WITH {_ECHO} SELECT * FROM told",
    "h11_evaluate_answers_fewshot": f"""WITH {_ECHO}, m AS (SELECT count(*) AS n,
    sqrt(avg((ground_truth - prediction) ** 2)) AS r, stddev_pop(ground_truth) AS d,
    avg(CASE WHEN source <> 'model_first_try' THEN 1.0::DOUBLE ELSE 0 END) AS f FROM told)
  SELECT n AS n_valid, round(r, 4) AS mean_rmse, round(r / (d + 1e-8::DOUBLE), 8) AS mean_nrmse,
    round(f, 9) AS fallback_rate FROM m""",
}
