"""Numbers out of free-text model answers."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import texts

# Which part of an answer counts as its number.
FIRST_NUMBER = r"[-+]?\d*\.?\d+"
NUMBER_TOKEN = r"[-+]?\d+(?:[.,]\d+)?(?:[eE][-+]?\d+)?"
PLAIN_NUMBER = r"^[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?$"
FENCED_TEXT = r"(?s)```(?:text|csv)?\s*(.*?)\s*```"
FENCED_CSV = r"(?s)```(?:csv)?\s*(.*?)\s*```"
EDGE_SPACE = r"^\s+|\s+$"


def _strip(col: Column) -> Column:
    return F.regexp_replace(col, EDGE_SPACE, "")


def _finite(col: Column) -> Column:
    v = col.try_cast("double")
    return F.when(F.abs(v) < F.lit(float("inf")), v)


def first_number(text: Column) -> Column:
    """First number in the text as it stands there."""
    token = F.regexp_extract(text, FIRST_NUMBER, 0)
    return _finite(F.when(token != "", token))


def fenced_content(text: Column, pattern: str = FENCED_TEXT) -> Column:
    """Longest fenced block (the first of equals), or the whole text."""
    blocks = F.regexp_extract_all(text, F.lit(pattern), 1)
    sized = F.transform(blocks, lambda b, i: F.struct(
        (-F.length(b)).alias("size"), i.alias("place"), b.alias("block")))
    longest = F.get(F.array_sort(sized), 0)["block"]
    return _strip(F.coalesce(longest, text))


def _one_separator(token: Column) -> Column:
    """Decimal comma or thousands marks to a plain decimal point."""
    comma, dot = F.instr(token, ","), F.instr(token, ".")
    last_comma = F.instr(F.reverse(token), ",")
    last_dot = F.instr(F.reverse(token), ".")
    return (
        F.when((comma > 0) & (dot > 0) & (last_comma < last_dot),
               F.replace(F.replace(token, F.lit("."), F.lit("")), F.lit(","), F.lit(".")))
        .when((comma > 0) & (dot > 0), F.replace(token, F.lit(","), F.lit("")))
        .otherwise(F.replace(token, F.lit(","), F.lit("."))))


def numeric_value(text: Column) -> Column:
    """Number in the longest fenced block: all of it, its first line, or its first token."""
    content = fenced_content(text)

    def whole(part: Column) -> Column:
        token = _one_separator(part)
        return F.when(token.rlike(PLAIN_NUMBER), _finite(token))

    first_line = _strip(F.get(F.split(content, r"\r\n|\r|\n"), 0))
    token = F.regexp_extract(content, NUMBER_TOKEN, 0)
    return F.coalesce(whole(content), whole(first_line),
                      _finite(_one_separator(F.when(token != "", token))))


def quoted(text: Column) -> Column:
    """Text as a quoted literal with escapes, None when absent."""
    escaped = text
    for plain, mark in (("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        escaped = F.replace(escaped, F.lit(plain), F.lit(mark))
    single, double = text.contains("'"), text.contains('"')
    body = (
        F.when(single & ~double, F.concat(F.lit('"'), escaped, F.lit('"')))
        .otherwise(F.concat(F.lit("'"), F.replace(escaped, F.lit("'"), F.lit("\\'")), F.lit("'"))))
    return F.coalesce(body, F.lit("None"))


def resolve_answers(
    df: DataFrame, first: str = "first_raw", retry: str = "retry_raw",
    fallback_value: str = "fallback_value", fallback_source: str = "fallback_source",
    read: Callable[[Column], Column] = first_number,
    tags: tuple[str, str] = (texts.FIRST_TRY, texts.RETRY),
) -> DataFrame:
    """Add prediction, source and raw_output: first answer, else retry, else fallback."""
    one, two = read(F.col(first)), read(F.col(retry))
    both = F.concat(F.lit("first_try="), quoted(F.col(first)),
                    F.lit(" | retry="), quoted(F.col(retry)))
    return df.withColumns({
        "prediction": F.coalesce(one, two, F.col(fallback_value)),
        "source": F.when(one.isNotNull(), F.lit(tags[0])).when(two.isNotNull(), F.lit(tags[1]))
        .otherwise(F.col(fallback_source)),
        "raw_output": F.when(one.isNotNull(), F.col(first))
        .when(two.isNotNull(), F.col(retry)).otherwise(both)})


def join_answers(
    rows: DataFrame, first: DataFrame, retry: DataFrame, keys: Sequence[str]
) -> DataFrame:
    """Rows with both answers (null where the model was not asked)."""
    def answers(df: DataFrame, name: str) -> DataFrame:
        return df.select(*keys, F.col("answer").alias(name))

    return (rows.join(answers(first, "first_raw"), list(keys), "left")
            .join(answers(retry, "retry_raw"), list(keys), "left"))


def score_with_model(
    df: DataFrame, scorer: Callable[[list], list], prompt: str = "messages",
    answer: str = "answer", partitions: int | None = None,
) -> DataFrame:
    """Ask a model for every row, in Arrow batches.

    `scorer` takes a list of prompts and returns as many texts; it is built by the
    caller and loads its model inside the Python worker. A few megabytes of prompts
    can be hours of work: `partitions` spreads them before they are asked.
    """
    asked = df if partitions is None else df.repartition(partitions)

    @F.pandas_udf("string")
    def ask(batch: pd.Series) -> pd.Series:
        return pd.Series(scorer(batch.tolist()), index=batch.index, dtype="object")

    # The request goes in as JSON, which is the same for chat messages and plain text.
    text = F.to_json(F.col(prompt)) if prompt == "messages" else F.col(prompt)
    return asked.withColumn(answer, ask(text))


def summarise_notes(notes: Column, shown: int = 5) -> Column:
    """Distinct notes joined by ` | `, cut after `shown` with a count of the rest."""
    unique = F.array_distinct(F.filter(notes, lambda n: n.isNotNull() & (n != "")))
    more = F.size(unique) - shown
    tail = F.when(more > 0, F.array(F.concat(F.lit("... (+"), more.cast("string"), F.lit(" more)"))))
    listed = F.concat(F.slice(unique, 1, shown), F.coalesce(tail, F.array().cast("array<string>")))
    return F.when(F.size(unique) > 0, F.array_join(listed, " | "))
