"""Prompt text and chat messages as column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import texts

MESSAGES = "array<struct<role:string,content:string>>"


def format_number(value: float | int | None) -> str:
    """A number as prompt text, on the driver (summary values)."""
    if value is None or value != value:
        return texts.MISSING
    if isinstance(value, int):
        return str(value)
    return f"{value:.6f}".rstrip("0").rstrip(".")


def format_value(name: str, kind: T.DataType) -> Column:
    """A cell as prompt text: six decimals at most, no trailing zeros."""
    c = F.col(name)
    if isinstance(kind, T.DoubleType | T.FloatType | T.DecimalType):
        v = c.cast("double")
        text = F.format_string("%.6f", v)
        text = F.regexp_replace(F.regexp_replace(text, "0+$", ""), "\\.$", "")
        return F.when(v.isNull() | F.isnan(v), F.lit(texts.MISSING)).otherwise(text)
    if isinstance(kind, T.BooleanType):
        return F.coalesce(F.initcap(c.cast("string")), F.lit(texts.MISSING))
    return F.coalesce(c.cast("string"), F.lit(texts.MISSING))


def _cells(schema: T.StructType, columns: Sequence[str], prefix: str = "") -> dict[str, Column]:
    return {c: format_value(prefix + c, schema[prefix + c].dataType) for c in columns}


def feature_text(
    schema: T.StructType, columns: Sequence[str], target: str | None = None, prefix: str = ""
) -> Column:
    """`name: value` lines; the target is never shown."""
    shown = [c for c in columns if c != target]
    return F.concat_ws("\n", *[
        F.concat(F.lit(f"{c}: "), text) for c, text in _cells(schema, shown, prefix).items()])


def stats_text(summary: Mapping[str, float] | None) -> str:
    if not summary:
        return texts.STATS_ABSENT
    lines = [f"- {k}: {format_number(summary[k])}" for k in texts.STATS_ORDER if k in summary]
    return "\n".join([texts.STATS_HEADING, *lines])


def guide_text(summary: Mapping[str, float] | None) -> str:
    if not summary:
        return texts.GUIDE_ABSENT
    lines = [f"- {label}: {format_number(summary.get(k))}" for label, k in texts.GUIDE_LINES]
    return "\n".join([texts.GUIDE_HEADING, *lines])


def _hints(hints: Sequence[str] | None) -> list[str]:
    return ["", texts.HINT_HEADING, *[f"- {h}" for h in hints]] if hints else []


def _lines(*parts: Column | str) -> Column:
    return F.concat_ws("\n", *[F.lit(p) if isinstance(p, str) else p for p in parts])


def user_text(
    schema: T.StructType, target: str, features: Sequence[str],
    summary: Mapping[str, float] | None = None, hints: Sequence[str] | None = None,
    prefix: str = "",
) -> Column:
    """The question about one record."""
    return _lines(
        texts.USER_OPENING, "", f"Target column: {target}", stats_text(summary), "",
        texts.FEATURE_HEADING, feature_text(schema, features, target, prefix),
        *_hints(hints), "", texts.USER_CLOSING)


def build_prompt(schema, target, features, summary=None, hints=None) -> Column:
    """System and user text as one plain prompt."""
    return F.concat(F.lit(texts.SYSTEM + "\n\n"),
                    user_text(schema, target, features, summary, hints))


def message(role: str, content: Column | str) -> Column:
    text = F.lit(content) if isinstance(content, str) else content
    return F.struct(F.lit(role).alias("role"), text.alias("content"))


def training_messages(
    df: DataFrame, target: str, features: Sequence[str], keys: Sequence[str] = (),
    summary: Mapping[str, float] | None = None, hints: Sequence[str] | None = None,
    strict: bool = False,
) -> DataFrame:
    """Keys and system/user/assistant messages of the rows with a target.

    With `strict`, a row without a target fails the job instead of being left out.
    """
    answer = format_value(target, df.schema[target].dataType)
    if strict:
        answer = F.when(F.col(target).isNotNull(), answer).otherwise(
            F.raise_error(F.lit(f"Training rows need a value in '{target}'.")))
        rows = df
    else:
        rows = df.where(F.col(target).isNotNull())
    return rows.select(*keys, F.array(
        message("system", texts.SYSTEM),
        message("user", user_text(df.schema, target, features, summary, hints)),
        message("assistant", answer)).alias("messages"))


def inference_messages(
    df: DataFrame, target: str, features: Sequence[str], keys: Sequence[str],
    summary: Mapping[str, float] | None = None, hints: Sequence[str] | None = None,
    examples: DataFrame | None = None,
) -> DataFrame:
    """Keys and messages: system, answered examples in order, the question.

    `examples` holds `keys`, `example_rank` and `example_<column>` (see `similar`);
    a row has at most k of them, so the collected list stays short.
    """
    question = message("user", user_text(df.schema, target, features, summary, hints))
    system = message("system", texts.SYSTEM)
    if examples is None:
        return df.select(*keys, F.array(system, question).alias("messages"))
    shown = user_text(examples.schema, target, features, summary, hints, "example_")
    answer = format_value(f"example_{target}", examples.schema[f"example_{target}"].dataType)
    demos = (
        examples.where(F.col(f"example_{target}").isNotNull())
        .groupBy(*keys)
        .agg(F.array_sort(F.collect_list(F.struct(
            "example_rank",
            F.array(message("user", shown), message("assistant", answer)).alias("pair"))))
            .alias("_demos"))
        .select(*keys, F.flatten(F.transform("_demos", lambda d: d["pair"])).alias("_demos")))
    staged = df.select(*keys, question.alias("_question")).join(demos, list(keys), "left")
    return staged.select(*keys, F.concat(
        F.array(system), F.coalesce(F.col("_demos"), F.array().cast(MESSAGES)),
        F.array(F.col("_question"))).alias("messages"))


def retry_messages(
    df: DataFrame, target: str, features: Sequence[str], keys: Sequence[str],
    summary: Mapping[str, float] | None = None, hints: Sequence[str] | None = None,
) -> DataFrame:
    """Shorter, stricter question for rows whose first answer had no number."""
    text = _lines(
        f"Target column: {target}", stats_text(summary), texts.FEATURE_HEADING,
        feature_text(df.schema, features, target), *_hints(hints), "", texts.RETRY_CLOSING)
    return df.select(*keys, F.array(
        message("system", texts.RETRY_SYSTEM), message("user", text)).alias("messages"))


def legacy_messages(
    df: DataFrame, target: str, features: Sequence[str], keys: Sequence[str]
) -> DataFrame:
    """The older wording, for models trained on it."""
    text = _lines("Observed values:", feature_text(df.schema, features, target), "",
                  f"Target column: {target}", "Imputed value:")
    return df.select(*keys, F.array(
        message("system", texts.LEGACY_SYSTEM), message("user", text)).alias("messages"))


def prompt_style(messages: Column) -> Column:
    """`legacy`, `current` or null, read from the first message."""
    first = F.lower(F.trim(F.get(messages, 0)["content"]))
    return (F.when(first.startswith(texts.LEGACY_SYSTEM_START), F.lit("legacy"))
            .when(first.contains(texts.CURRENT_SYSTEM_PART), F.lit("current")))


def record_prompt(
    schema: T.StructType, dataset: str, target: str, features: Sequence[str],
    summary: Mapping[str, float] | None = None, hints: Sequence[str] | None = None,
    retry: bool = False,
) -> Column:
    """One-record prompt that warns against constant answers."""
    text = _lines(
        texts.RECORD_OPENING.format(dataset=dataset, target=target), guide_text(summary), "",
        texts.FEATURE_HEADING, feature_text(schema, features, target), "", texts.RECORD_RULES,
        *_hints(hints), "", texts.RECORD_CLOSING.format(target=target))
    return F.concat(text, F.lit(texts.RECORD_RETRY)) if retry else text


def _number_cells(values: list) -> list[str] | None:
    """Doubles as `DataFrame.to_string` writes a column of them; None where it may turn to exponents."""
    known = [v for v in values if v is not None and v == v]
    if any(abs(v) > 1e6 or 0 < abs(v) < 2e-6 for v in known):
        return None
    if not known:
        return ["NaN"] * len(values)
    cells = [f"{v: .6f}" for v in known]
    least = min(len(c) - len(c.rstrip("0")) for c in cells)
    cells = iter([c[:len(c) - min(least, 5)] for c in cells])
    return [next(cells) if v is not None and v == v else " NaN" for v in values]


def _pandas_frame(names: Sequence[str], kinds: Sequence[str], columns: Sequence[list]) -> pd.DataFrame:
    types = ["object" if k == "text" else "int64" if k == "int" and None not in v else "float64"
             for k, v in zip(kinds, columns, strict=True)]
    parts = [pd.Series(v, dtype=t) for v, t in zip(columns, types, strict=True)]
    return pd.concat(parts, axis=1).set_axis(list(names), axis=1)


def matrix_text(names: Sequence[str], kinds: Sequence[str], columns: Sequence[list]) -> str:
    """The same text as `to_string` of a DataFrame of these columns; kinds are `int`, `float` and `text`.

    Integers with a null are doubles there. Laying out a block of a few rows takes a hundredth of pandas' time.
    """
    size = len(columns[0])
    laid = [["", *map(str, range(size))]]
    laid = [[c.ljust(max(map(len, laid[0]))) for c in laid[0]]]
    for name, kind, values in zip(names, kinds, columns, strict=True):
        if kind == "text":
            head, cells = name, [" " + v if v is not None else " None" for v in values]
            plain = all(c.isprintable() for c in cells)
        else:
            whole = kind == "int" and None not in values
            cells = [f"{v: d}" for v in values] if whole else _number_cells(
                [None if v is None else float(v) for v in values])
            head, plain = " " + name, cells is not None
        if not plain or not head.isprintable():
            return _pandas_frame(names, kinds, columns).to_string()
        width = max(map(len, [head, *cells]))
        laid.append([c.rjust(width) for c in [head, *cells]])
    return "\n".join(map(" ".join, zip(*laid, strict=True)))


MATRIX_KINDS = {"tinyint": "int", "smallint": "int", "int": "int", "bigint": "int", "double": "float", "string": "text"}


def matrix_prompts(
    df: DataFrame, dataset: str, columns: Sequence[str], batch: Sequence[str] = ("batch_id",),
    position: str = "position", retry: bool = False,
) -> DataFrame:
    """One prompt per batch with the batch as a text matrix, laid out as pandas does.

    A batch has a fixed number of rows (`batch_rows`), so a group is small: it travels as one row of arrays. Columns of
    other types than numbers and texts go through pandas, batch by batch.
    """
    batch, columns = list(batch), list(columns)
    wording = texts.MATRIX_PROMPT + (texts.MATRIX_RETRY if retry else "")
    kinds = [MATRIX_KINDS.get(df.schema[c].dataType.simpleString()) for c in columns]

    def prompt(matrix: str, n_rows: int) -> str:
        return wording.format(
            dataset=dataset, matrix=matrix, header=", ".join(columns),
            n_columns=len(columns), n_commas=len(columns) - 1, n_rows=n_rows)

    fields = [df.schema[b] for b in batch]
    schema = T.StructType([*fields, T.StructField("n_rows", T.LongType()),
                           T.StructField("prompt", T.StringType())])
    rows = df.select(*batch, position, *columns)
    if None in kinds:
        def render(pdf):
            pdf = pdf.sort_values(position)
            matrix = pdf[columns].reset_index(drop=True)
            out = pdf[batch].head(1).copy()
            out["n_rows"] = len(matrix)
            out["prompt"] = prompt(matrix.to_string(), len(matrix))
            return out

        return rows.groupBy(*batch).applyInPandas(render, schema)

    cells = F.struct(F.col(position).alias("at"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(columns)])
    # A block costs far more than its bytes show, so small blocks are dealt to all tasks, too.
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = rows.repartition(tasks, *batch).groupBy(*batch).agg(F.sort_array(F.collect_list(cells)).alias("_cells"))

    def render_all(batches):
        for part in batches:
            lists = part.column(len(batch))
            ends = lists.offsets.to_pylist()
            found = lists.values
            values = [found.field(i + 1).to_pylist() for i in range(len(columns))]
            sizes = [b - a for a, b in zip(ends, ends[1:])]
            out = [prompt(matrix_text(columns, kinds, [v[a:b] for v in values]), b - a)
                   for a, b in zip(ends, ends[1:])]
            yield pa.RecordBatch.from_arrays(
                [*part.columns[:-1], pa.array(sizes, pa.int64()), pa.array(out, pa.string())],
                [*part.schema.names[:-1], "n_rows", "prompt"])

    return blocks.mapInArrow(render_all, schema)


def assistant_target(messages: Column) -> Column:
    """Number in the last message when the assistant wrote it."""
    from .answers import first_number

    last = F.try_element_at(messages, F.lit(-1))
    return F.when(last["role"] == "assistant", first_number(last["content"]))


def prompt_only(messages: Column) -> Column:
    """Messages without the closing assistant turn; any other ending fails."""
    last = F.try_element_at(messages, F.lit(-1))
    return F.when(last["role"] == "assistant",
                  F.slice(messages, F.lit(1), F.size(messages) - 1)).otherwise(
        F.raise_error(F.lit("A training record must end with an assistant message.")))
