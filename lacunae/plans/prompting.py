"""End-to-end use of a model: training sets, row answers, matrix answers."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions import texts
from ..operators import answers, folds, matrix, profile, prompts
from ..operators.evaluate import answer_metrics
from ..operators.fallback import domain_fallback, product_or_default
from ..operators.order import exact_quantiles, number, with_position
from ..operators.similar import top_similar
from ..session import cut_lineage

Scorer = Callable[[list], list]


def training_dataset(
    spark: SparkSession, scenarios: Iterable[tuple[str, str, DataFrame]],
    ids: Sequence[str] = (), mode: str = "primary_missing",
    targets: Sequence[str] | None = None, hints: Sequence[str] | None = None,
) -> tuple[DataFrame | None, DataFrame]:
    """(chat records with input_table, mechanism and target_column; preparation manifest).

    Scenarios are (name, mechanism, table); one without a numeric target with
    holes is listed as skipped.
    """
    parts, rows = [], []
    for name, mechanism, df in scenarios:
        id_columns = profile.detect_id_columns(df, ids)
        table = profile.coerce_numeric(df, exclude=list(id_columns))
        chosen = profile.resolve_targets(table, id_columns, mode, targets)
        if not chosen:
            rows.append((name, mechanism, None, "skipped", "no_numeric_missing_target_found",
                         None, table.count(), 0, None, None))
        for target in chosen:
            features = profile.feature_columns(table, target, id_columns)
            summary = profile.target_summary(table, target)
            chat = prompts.training_messages(table, target, features, (), summary, hints)
            parts.append(chat.select(
                F.lit(name).alias("input_table"), F.lit(mechanism).alias("mechanism"),
                F.lit(target).alias("target_column"), "messages"))
            size = table.agg(F.count(F.lit(1)).alias("n"), F.count(target).alias("m")).first()
            rows.append((name, mechanism, target, "prepared", None, f"{name}__target_{target}",
                         size["n"], size["m"], size["n"] - size["m"], size["m"]))
    chats = reduce(DataFrame.unionByName, parts) if parts else None
    return chats, spark.createDataFrame(rows, schemas.PREPARE_ROW)


def evaluate_answers(
    full: DataFrame, holed: DataFrame, keys: Sequence[str], target: str, features: Sequence[str],
    scorer: Scorer, few_shot_k: int = 0, retry_scorer: Scorer | None = None,
    factors: Sequence[str] | None = None, hints: Sequence[str] | None = None,
    style: str = "current", limit: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(detail rows, summary) of a model asked for every row without a target.

    First answer, one retry for answers without a number, then the fallback. The
    summary and the fallback median come from the observed rows only, so the truth
    of the holes does not leak into a prompt.
    """
    keys = list(keys)
    observed, open_rows = profile.split_observed(holed, target, limit, keys)
    summary = profile.target_summary(observed, target)
    if not summary:
        raise ValueError(f"'{target}' has no observed value.")
    examples = None
    if few_shot_k:
        examples = top_similar(open_rows, observed, keys, target, features, few_shot_k)
    if style == "legacy":
        first = second = prompts.legacy_messages(open_rows, target, features, keys)
    else:
        first = prompts.inference_messages(
            open_rows, target, features, keys, summary, hints, examples)
        second = prompts.retry_messages(open_rows, target, features, keys, summary, hints)
    # Answers are expensive and may differ when asked again: keep them.
    told = cut_lineage(answers.score_with_model(first, scorer).select(*keys, "answer"))
    unread = told.where(answers.first_number(F.col("answer")).isNull()).select(*keys)
    retold = cut_lineage(answers.score_with_model(
        second.join(unread, keys, "left_semi"), retry_scorer or scorer).select(*keys, "answer"))
    rows = domain_fallback(open_rows, target, factors, summary["median"])
    resolved = answers.resolve_answers(answers.join_answers(rows, told, retold, keys))
    truth = full.select(*keys, number(target).alias("ground_truth"))
    detail = resolved.join(truth, keys).select(
        *keys, "prediction", "ground_truth",
        F.abs(F.col("prediction") - F.col("ground_truth")).alias("abs_error"),
        "source", "raw_output")
    return detail, answer_metrics(detail)


def _ask_blocks(rows: DataFrame, dataset: str, columns: list[str], scorer: Scorer, retry: bool):
    """Prompt per block, answer, parsed and aligned table; kept, so that nothing is asked or read twice."""
    asked = prompts.matrix_prompts(rows, dataset, columns, ["row_start"], "position", retry)
    told = answers.score_with_model(asked, scorer, "prompt", "response").drop("prompt")
    parsed = matrix.parse_matrix_responses(told, len(columns))
    return cut_lineage(matrix.align_matrix(parsed, columns, recover=True).select(
        "row_start", "aligned", "align_error", "recovery_note"))


def _fill_columns(active: DataFrame, block: list[str], first_col: int, target: str, settings: dict) -> tuple[DataFrame, DataFrame]:
    """Answers of a round for one block of columns: (rows with the target's answer, block notes).

    Notes have row_start, whether the block is lost, and what was wrong.
    """
    scorer, dataset = settings["scorer"], settings["dataset"]
    first = _ask_blocks(active, dataset, block, scorer, retry=False)
    again = first.where(F.col("align_error").isNotNull()).select("row_start")
    second = _ask_blocks(active.join(again, "row_start", "left_semi"), dataset, block,
                         settings["retry_scorer"] or scorer, retry=True)
    good = first.where(F.col("align_error").isNull()).unionByName(
        second.where(F.col("align_error").isNull()))
    place = f"c{first_col}-{first_col + len(block)}"
    lost = second.where(F.col("align_error").isNotNull())
    notes = lost.select("row_start", F.lit(True).alias("lost"), F.col("align_error").alias("note")).unionByName(
        good.where(F.col("recovery_note").isNotNull()).select(
            "row_start", F.lit(False).alias("lost"), F.col("recovery_note").alias("note")))
    notes = notes.withColumn("note", F.concat(F.lit(place + ":"), "note"))
    if target not in block:
        return active.select("position", "row_start", F.lit(None).cast("double").alias("answer__target")), notes
    told = matrix.explode_aligned(good, block, ["row_start"])
    placed = active.withColumn("row_in_batch", F.col("position") - F.col("row_start"))
    merged = matrix.recover_partial_rows(placed, told, block, ["row_start"])
    return merged.select("position", "row_start", F.when(
        F.col("answered"), profile.text_number(F.col(target))).alias("answer__target")), notes


def fill_matrix(
    rows: DataFrame, target: str, columns: Sequence[str], scorer: Scorer, dataset: str,
    batch_row: int = 40, min_batch_row: int = 1, retry_scorer: Scorer | None = None,
    batch_col: int | None = None, shown_notes: int = 5,
) -> DataFrame:
    """Rows (position, columns) with the model's `answer__target`, block by block.

    A block is a run of rows by `batch_col` columns (default: all). A block of rows in which an answer cannot be used,
    or leaves a target open, is asked once more with a stricter prompt and then halved along the rows, down
    to `min_batch_row`; the halves keep its log. `error` is what was wrong with the last block of a row, `notes`
    sums up the log of all blocks that it was in.
    """
    columns = list(columns)
    if batch_row < 1 or min_batch_row < 1 or (batch_col is not None and batch_col < 1):
        raise ValueError("Block sizes must be at least 1.")
    wide = len(columns) if batch_col is None else min(batch_col, len(columns))
    blocks_of_columns = [columns[i:i + wide] for i in range(0, len(columns), wide)]
    settings = {"scorer": scorer, "dataset": dataset, "retry_scorer": retry_scorer}
    begun = [F.lit(f"column_blocks({wide}/{len(columns)})")] if wide < len(columns) else []
    active = rows.withColumns({
        "row_start": F.floor(F.col("position") / batch_row).cast("long") * batch_row,
        "row_end": (F.floor(F.col("position") / batch_row).cast("long") + 1) * batch_row,
        "log": F.array(*begun).cast("array<string>")})
    done = []
    for _ in range(math.ceil(math.log2(max(batch_row, 2))) + 1):
        answers_, notes = None, None
        for i, block in enumerate(blocks_of_columns):
            told, noted = _fill_columns(active, block, i * wide, target, settings)
            answers_ = told if answers_ is None or target in block else answers_
            notes = noted if notes is None else notes.unionByName(noted)
        merged = cut_lineage(answers_)
        found = cut_lineage(notes.groupBy("row_start").agg(
            F.max("lost").alias("lost"), F.array_sort(F.collect_list("note")).alias("new")))
        state = active.join(merged, ["position", "row_start"])
        still = F.col(target).isNull() & F.col("answer__target").isNull()
        size = state.groupBy("row_start", "row_end").agg(
            F.max("position").alias("_last"), F.count_if(still).alias("n_open"), F.first("log").alias("log"))
        size = size.withColumn("row_end", F.least("row_end", F.col("_last") + 1)).join(found, "row_start", "left")
        name = F.concat(F.lit("r"), "row_start", F.lit("-"), "row_end")
        fresh = F.concat(
            F.transform(F.coalesce("new", F.array().cast("array<string>")), lambda n: F.concat(name, F.lit("_"), n)),
            F.when(F.col("n_open") > 0, F.array(F.concat(name, F.lit(":target_open("), "n_open", F.lit(")")))).otherwise(
                F.array().cast("array<string>")))
        blocks = size.select("row_start", "row_end", F.concat("log", fresh).alias("log"),
                             F.when(F.size(fresh) > 0, F.array_join(fresh, " | ")).alias("_wrong"),
                             (F.coalesce("lost", F.lit(False)) | (F.col("n_open") > 0)).alias("failed"))
        blocks = cut_lineage(blocks)
        kept, halves = matrix.split_failed_batches(blocks, F.col("failed"), min_rows=min_batch_row)
        log = F.when(F.size("log") > 0, answers.summarise_notes(F.col("log"), shown_notes))
        ended = kept.select("row_start", F.when(F.col("failed"), F.col("_wrong")).alias("error"), log.alias("notes"))
        done.append(state.drop("log").join(ended, "row_start").drop("row_start", "row_end"))
        halves = cut_lineage(halves.select("row_start", "row_end", F.concat("log", F.array(F.concat(
            F.lit("half("), "row_start", F.lit("-"), "row_end", F.lit(")")))).alias("log")))
        if halves.isEmpty():
            break
        inside = ((F.col("position") >= F.col("row_start"))
                  & (F.col("position") < F.col("row_end")))
        # Blocks are numbered by their start, so the range join is an equi-join on the old block.
        old = F.floor(F.col("position") / batch_row).cast("long")
        active = rows.withColumn("_old", old).join(
            halves.withColumn("_old", F.floor(F.col("row_start") / batch_row).cast("long")),
            "_old").where(inside).drop("_old")
    return reduce(DataFrame.unionByName, done)


def impute_by_matrix(
    full: DataFrame, holed: DataFrame, keys: Sequence[str], target: str, columns: Sequence[str],
    scorer: Scorer, dataset: str, n_rows: int | None = None, n_folds: int = 1,
    fold_prompt_rows: int | None = None, batch_row: int = 40, min_batch_row: int = 1,
    factors: Sequence[str] | None = None, retry_scorer: Scorer | None = None, batch_col: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(detail rows, summary) of a model that completes whole tables.

    With `batch_col` a prompt shows that many columns. Each detail row has the `error` of its last block, if
    that was not answered in full, and the `notes` of all its blocks.

    All rows take part unless `n_rows` asks for the first ones, and a prompt shows all rows of a
    fold unless `fold_prompt_rows` sets a budget.
    With several folds, only the holes of one fold are open at a time, the others
    show the truth, and the prompt keeps the rows nearest to the open ones.
    """
    keys, columns = list(keys), list(columns)
    shown_columns = list(dict.fromkeys([*keys, *columns]))
    placed = with_position(holed.select(*shown_columns), keys, "position")
    if n_rows is not None:
        placed = placed.where(F.col("position") < n_rows)
    placed = cut_lineage(placed)
    open_rows = placed.where(F.col(target).isNull())
    if open_rows.isEmpty():
        raise ValueError(f"None of the chosen rows misses '{target}'.")
    truth = full.select(*keys, number(target).alias("ground_truth"))
    settings = dict(target=target, columns=columns, scorer=scorer, dataset=dataset,
                    batch_row=batch_row, min_batch_row=min_batch_row, retry_scorer=retry_scorer,
                    batch_col=batch_col)
    if n_folds == 1:
        told = fill_matrix(placed, **settings)
        found = told.where(F.col(target).isNull()).select(
            *keys, "position", F.lit(1).alias("fold_id"), "answer__target", "error", "notes")
        tag = texts.MATRIX_SOURCE
    else:
        numbered = folds.contiguous_folds(open_rows, ["position"], n_folds)
        marks = cut_lineage(numbered.select("position", "fold_id"))
        k = marks.agg(F.max("fold_id")).first()[0]
        shown = placed.join(marks, "position", "left").join(truth, keys)
        parts = []
        for fold in range(1, k + 1):
            fold_rows = shown.withColumns({
                target: folds.fold_reveal(target, "ground_truth", "fold_id", fold),
                "required": F.coalesce(F.col("fold_id") == fold, F.lit(False))})
            compact = folds.compact_context(fold_rows, target, "required", fold_prompt_rows)
            compact = cut_lineage(compact.select(
                *shown_columns, "required", F.col("context_position").alias("position")))
            told = fill_matrix(compact, **settings)
            parts.append(told.where("required").select(
                *keys, "position", F.lit(fold).alias("fold_id"), "answer__target", "error", "notes"))
        found = reduce(DataFrame.unionByName, parts)
        tag = texts.MATRIX_FOLD_SOURCE
    middle = exact_quantiles(holed, [target], [0.5])[target]
    if middle is None:
        raise ValueError(f"'{target}' has no observed value.")
    value, source = product_or_default(factors, middle[0])
    context = placed.select(*keys, value.alias("_value"), source.alias("_source"))
    answer = F.col("answer__target")
    detail = found.join(context, keys).join(truth, keys).select(
        *keys, F.col("position").alias("prompt_row_position"), "fold_id",
        F.coalesce(answer, F.col("_value")).alias("prediction"), "ground_truth",
        F.when(answer.isNotNull(), F.lit(tag)).otherwise(F.col("_source")).alias("source"), "error", "notes")
    return detail, answer_metrics(detail)
