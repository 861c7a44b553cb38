import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from lacunae.functions import texts
from lacunae.operators import answers, prompts
from lacunae.operators.answers import first_number, numeric_value


@pytest.fixture
def record(spark):
    return spark.createDataFrame(
        [(1, 2, 0.5, None, 36, "A11"), (2, 3, 1e-7, 2.50, None, None)],
        "k int, X1 int, X3 double, X4 double, X2 int, code string")


SUMMARY = {"min": 4.0, "q1": 12.0, "median": 18.0, "q3": 24.0, "max": 60.0, "mean": 20.70888888}


def test_values_as_text(spark):
    df = spark.createDataFrame(
        [(1.0, 10), (0.1234567, None), (100.0, 5), (None, 0), (float("nan"), 1), (-2.50, 2)],
        "v double, i int")
    got = [r[0] for r in df.select(prompts.format_value("v", df.schema["v"].dataType)).collect()]
    assert got == ["1", "0.123457", "100", "MISSING", "MISSING", "-2.5"]
    ints = [r[0] for r in df.select(prompts.format_value("i", df.schema["i"].dataType)).collect()]
    assert ints == ["10", "MISSING", "5", "0", "1", "2"]
    assert prompts.format_number(20.708889) == "20.708889"
    assert prompts.format_number(None) == "MISSING" and prompts.format_number(7) == "7"


def test_training_record_wording(record):
    got = prompts.training_messages(
        record, "X2", ["X1", "X2", "X3", "X4", "code"], ["k"], SUMMARY, ["a hint"]).collect()
    assert len(got) == 1
    system, user, assistant = got[0]["messages"]
    assert (system["role"], user["role"], assistant["role"]) == ("system", "user", "assistant")
    assert system["content"] == texts.SYSTEM and assistant["content"] == "36"
    assert user["content"] == (
        "Impute the missing target value for this record.\n\nTarget column: X2\n"
        "Target distribution summary (observed rows):\n- min: 4\n- q1: 12\n- median: 18\n"
        "- q3: 24\n- max: 60\n- mean: 20.708889\n\nObserved feature values:\nX1: 2\nX3: 0.5\n"
        "X4: MISSING\ncode: A11\n\nDomain hints:\n- a hint\n\nHere are the output constraints:\n"
        "- Return exactly one number.\n"
        "- No words, no units, no commas, no explanation, no markdown.\nImputed value:")


def test_strict_training_fails_on_an_open_target(record):
    strict = prompts.training_messages(record, "X2", ["X1"], ["k"], SUMMARY, strict=True)
    with pytest.raises(Exception, match="need a value"):
        strict.collect()


def test_examples_come_in_order_and_open_ones_are_left_out(spark, record):
    examples = spark.createDataFrame(
        [(2, 2, 8, 5), (2, 1, 9, 6), (2, 3, 7, None)],
        "k int, example_rank int, example_X1 int, example_X2 int")
    got = prompts.inference_messages(
        record.where("k = 2"), "X2", ["X1"], ["k"], {}, None, examples).first()["messages"]
    assert [m["role"] for m in got] == ["system", "user", "assistant", "user", "assistant", "user"]
    assert [m["content"] for m in got][2::2] == ["6", "5"]
    assert "X1: 9" in got[1]["content"] and "X1: 3" in got[5]["content"]
    assert texts.STATS_ABSENT in got[5]["content"]
    plain = prompts.inference_messages(record, "X2", ["X1"], ["k"], SUMMARY, None, examples)
    assert plain.where("k = 1").first()["messages"][1]["role"] == "user"


def test_styles(spark, record):
    old = prompts.legacy_messages(record, "X2", ["X1"], ["k"])
    new = prompts.retry_messages(record, "X2", ["X1"], ["k"], SUMMARY)
    style = prompts.prompt_style(F.col("messages"))
    assert {r[0] for r in old.select(style).collect()} == {"legacy"}
    assert {r[0] for r in new.select(style).collect()} == {None}
    empty = spark.createDataFrame([([],)], f"messages {prompts.MESSAGES}")
    assert empty.select(style).first()[0] is None


def test_record_endings(spark):
    df = spark.createDataFrame(
        [([("user", "q"), ("assistant", "about 12.5")],), ([("assistant", "1"), ("user", "7")],)],
        f"messages {prompts.MESSAGES}")
    assert [r[0] for r in df.select(prompts.assistant_target(F.col("messages"))).collect()] == [
        12.5, None]
    closed = df.where(F.col("messages")[1]["role"] == "assistant")
    cut = closed.select(prompts.prompt_only(F.col("messages")).alias("m"))
    assert [m["content"] for m in cut.first()["m"]] == ["q"]
    cut = df.select(prompts.prompt_only(F.col("messages")).alias("m"))
    with pytest.raises(Exception, match="assistant message"):
        cut.collect()


def test_matrix_prompt_layout(spark):
    df = spark.createDataFrame(
        [(0, 0, 1, 2.5), (0, 1, 10, None), (1, 2, 3, 4.0)],
        "batch_id long, position long, a int, b double")
    got = {r["batch_id"]: r for r in prompts.matrix_prompts(df, "Demo", ["a", "b"]).collect()}
    assert got[0]["n_rows"] == 2
    assert "    a    b\n0   1  2.5\n1  10  NaN\n" in got[0]["prompt"]
    assert "2. Return exactly 2 data rows" in got[0]["prompt"] and "[a, b]" in got[0]["prompt"]
    retry = prompts.matrix_prompts(df, "Demo", ["a", "b"], retry=True).where("batch_id = 1").first()
    assert retry["prompt"].endswith("- Do not return explanations.\n")


CASES = {
    # text: (first number, numeric value)
    "12": (12.0, 12.0),
    " 12.5 ": (12.5, 12.5),
    "Answer: -3.5": (-3.5, -3.5),
    ".5": (0.5, 0.5),
    "1,234.56": (1.0, 1234.56),
    "1.234,56": (1.234, 1234.56),
    "123,45": (123.0, 123.45),
    "1e3": (1.0, 1000.0),
    "-.5": (-0.5, -0.5),
    "```text\n7\n```": (7.0, 7.0),
    "```\n7\n``` and ```csv\n1234\n```": (7.0, 1234.0),
    "12\nbecause": (12.0, 12.0),
    "about 3,5 or 4": (3.0, 3.5),
    "": (None, None),
    "n/a": (None, None),
    "nan": (None, None),
    "inf": (None, None),
}


def test_numbers_in_answers(spark):
    df = spark.createDataFrame([(t,) for t in [*CASES, None]], "t string")
    rows = df.select("t", first_number(F.col("t")).alias("a"),
                     numeric_value(F.col("t")).alias("b")).collect()
    got = {r["t"]: (r["a"], r["b"]) for r in rows}
    assert got.pop(None) == (None, None)
    assert got == CASES


def test_resolving(spark):
    df = spark.createDataFrame(
        [("1", None), ("x", "2"), ("it's", None), ('a"\n\'', "\\")], "first_raw string, retry_raw string")
    df = df.withColumns({"fallback_value": F.lit(9.0), "fallback_source": F.lit("fallback_median")})
    got = [(r["prediction"], r["source"], r["raw_output"])
           for r in answers.resolve_answers(df).collect()]
    assert got == [
        (1.0, "model_first_try", "1"), (2.0, "model_retry", "2"),
        (9.0, "fallback_median", f"first_try={'it' + chr(39) + 's'!r} | retry={None!r}"),
        (9.0, "fallback_median", f"first_try={'a' + chr(34) + chr(10) + chr(39)!r} | retry={chr(92)!r}")]


def test_notes(spark):
    df = spark.createDataFrame(
        [(["a", "", "b", "a", None, "c", "d"],), ([],), (["x"],)], "n array<string>")
    got = [r[0] for r in df.select(answers.summarise_notes(F.col("n"), 3)).collect()]
    assert got == ["a | b | c | ... (+1 more)", None, "x"]


def layout(columns):
    def render(pdf):
        block = pdf.sort_values("position")[columns].reset_index(drop=True)
        return pd.DataFrame({"batch_id": pdf["batch_id"].head(1), "text": block.to_string()})
    return render


def test_matrix_text_is_that_of_pandas(spark):
    """Random blocks of all kinds of columns, the pandas layout per batch as the measure."""
    rng = random.Random(5)
    floats = [None, 0.0, -0.0, 1.0, -2.5, 711.56, 1 / 3, 123456.789, 999999.5, 1e6, 1.5e6, 3e9, 1e-5, 1e-7, float("nan"), float("inf")]
    words = [None, "", "a", "BUILDING", "NaN", "é ü", "a b ", "line\nfeed", "日本", "0x1", 'q"q']
    rows = []
    for batch in range(400):
        some = rng.sample(floats, rng.choice([1, 2, 3, len(floats)]))
        ints = rng.choice([[1, 20, -300], [None, 5], [None], [10**12, 7]])
        rows += [(batch, at, rng.choice(ints), rng.choice(some), rng.choice(words)) for at in range(rng.randrange(1, 13))]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "batch_id long, position long, a long, bb double, long_name string")
    for columns in (["a", "bb", "long_name"], ["long_name"], ["bb"], ["a"]):
        expected = dict(df.groupBy("batch_id").applyInPandas(
            layout(columns), "batch_id long, text string").collect())
        asked = prompts.matrix_prompts(df, "Demo", columns)
        assert "FlatMapGroupsInPandas" not in asked._jdf.queryExecution().optimizedPlan().toString()
        got = {r.batch_id: r for r in asked.collect()}
        assert got.keys() == expected.keys()
        for batch, text in expected.items():
            assert f"Matrix:\n    {text}\n\n    Output Format" in got[batch].prompt
            assert got[batch].n_rows == sum(r[0] == batch for r in rows)
