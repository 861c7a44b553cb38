import pytest
from pyspark.sql import functions as F

from lacunae.operators import inject, matrix
from lacunae.operators.order import with_position
from lacunae.plans.prompting import impute_by_matrix

COLUMNS = ["a", "b"]
GOOD = [["1", "x"], ["2", None]]


def _parse(spark, text, n_rows=2, recover=False, columns=COLUMNS):
    df = spark.createDataFrame([(0, n_rows, text)], "batch_id long, n_rows long, response string")
    parsed = matrix.parse_matrix_responses(df, len(columns))
    row = matrix.align_matrix(parsed, columns, recover=recover).first()
    return row["aligned"], row["align_error"], row["recovery_note"]


@pytest.mark.parametrize("text", [
    "a,b\n1,x\n2,", "a;b\n1;x\n2;NaN", "a\tb\n1\tx\n2\tnull", "1,x\n2,n/a",
    "Sure:\n```csv\nb,a\nx,1\n,2\n```", "| a | b |\n|---|:-:|\n| 1 | x |\n| 2 | NA |",
    "Unnamed,a,b\n0,1,x\n1,2,", ",a,b\n0,1,x\n1,2,NaN", "a b\n1 x\n2 NaN",
    "```\nno\n```\n```csv\na,b\n1,x\n2,\n```", 'a,b\n"1",x\n2,', "a,b\n9,z\n1,x\n2,",
    "a,b\n0,1,x\n1,2,NA"])
def test_layouts(spark, text):
    assert _parse(spark, text) == (GOOD, None, None)


def test_quoted_separators(spark):
    assert _parse(spark, 'a,b\n1,"x, y"\n2,"z"')[0] == [["1", "x, y"], ["2", "z"]]


def test_errors(spark):
    assert _parse(spark, "")[1] == "empty answer, expected 2 x 2 cells"
    assert _parse(spark, None)[1].startswith("empty answer")
    assert "single column" in _parse(spark, "a\n1\n2")[1]
    assert "The table does not fit 2 columns: it has 4" == _parse(
        spark, "w,x,y,z\n1,2,3,4\n5,6,7,8")[1]
    assert "too short, rows: 2 of 3" in _parse(spark, "a,b\n1,x", 2 + 1)[1] or \
        "(2 < 3)" in _parse(spark, "a,b\n1,x", 3)[1]


def test_short_tables_can_be_recovered(spark):
    rows, error, note = _parse(spark, "a,b\n1,x\n2,y\n3,z", 4, recover=True)
    # The reading without a header is one row closer to four rows, so it wins.
    assert (rows, error, note) == (
        [["a", "b"], ["1", "x"], ["2", "y"], ["3", "z"]], None, None)
    rows, error, note = _parse(spark, "a,b\n1,x\n2,y", 5, recover=True)
    assert error is None and note == "partial_rows_recovered(3->5)" and len(rows) == 3


def test_recovery_fills_the_tail(spark):
    shown = spark.createDataFrame(
        [(0, i, float(i)) for i in range(4)], "batch_id long, row_in_batch long, v double")
    told = spark.createDataFrame([(0, 0, "9"), (0, 1, None)],
                                 "batch_id long, row_in_batch long, v string")
    got = matrix.recover_partial_rows(shown, told, ["v"]).orderBy("row_in_batch").collect()
    assert [(r["v"], r["answered"]) for r in got] == [
        ("9", True), (None, True), ("2.0", False), ("3.0", False)]


def test_halving(spark):
    blocks = spark.createDataFrame(
        [(0, 7, True), (7, 8, True), (8, 16, False), (16, 20, None)],
        "row_start long, row_end long, failed boolean")
    kept, halves = matrix.split_failed_batches(blocks, F.col("failed"))
    assert sorted((r["row_start"], r["row_end"]) for r in kept.collect()) == [(7, 8), (8, 16), (16, 20)]
    assert sorted((r["row_start"], r["row_end"]) for r in halves.collect()) == [(0, 3), (3, 7)]
    _, none = matrix.split_failed_batches(blocks, F.col("failed"), min_rows=7)
    assert none.count() == 0


def test_blocks(spark):
    placed = with_position(spark.range(10).withColumnRenamed("id", "k"), ["k"])
    got = matrix.batch_rows(placed, 4).orderBy("k").collect()
    assert [r["batch_id"] for r in got] == [0] * 4 + [1] * 4 + [2] * 2
    wide = matrix.batch_rows(placed, 4, "position", 2, ["a", "b", "c"])
    assert sorted({(r["col_block"], tuple(r["block_columns"])) for r in wide.collect()}) == [
        (0, ("a", "b")), (1, ("c",))]
    with pytest.raises(ValueError):
        matrix.batch_rows(placed, 0)


def test_writing_back(spark):
    table = spark.createDataFrame([(1, 1, "a"), (2, None, "b"), (3, 3, "c")], "k int, v int, t string")
    block = spark.createDataFrame([(2, "7", "z"), (3, "x", None)], "k int, v string, t string")
    got = matrix.write_back(table, block, ["k"], ["v", "t"]).orderBy("k").collect()
    assert [tuple(r) for r in got] == [(1, 1, "a"), (2, 7, "z"), (3, None, None)]
    assert matrix.added_nulls(block, ["v"]).first()["added_nulls"] == 1


def _fills(double):
    """A model that fills each hole with a tenth of the row's key, or refuses long tables."""
    def scorer(prompts):
        out = []
        for p in prompts:
            body = p.split("Matrix:\n    ")[1].split("\n\n    Output Format")[0].split("\n")[1:]
            rows = [r.split()[1:] for r in body]
            if len(rows) > 6:
                out.append("I cannot do that")
            else:
                out.append("k,y\n" + "\n".join(
                    f"{k},{float(k) / 10 if y == 'NaN' else y}" for k, y in rows))
        return out
    return scorer


@pytest.mark.parametrize("n_folds", [1, 3])
def test_whole_matrix_runs(numbers, n_folds):
    full = numbers.where("k < 60").select("k", "y")
    holed = inject.mcar_column(full, 0.25, "y", ["k"])
    detail, summary = impute_by_matrix(
        full, holed, ["k"], "y", ["k", "y"], _fills(2), "Demo", n_rows=50, n_folds=n_folds,
        fold_prompt_rows=20, batch_row=16)
    rows = detail.collect()
    open_keys = {r["k"] for r in holed.where("y is null and k < 50").collect()}
    assert {r["k"] for r in rows} == open_keys
    assert all(r["prediction"] == pytest.approx(r["k"] / 10) for r in rows)
    assert {r["source"] for r in rows} == {"paper_prompt" if n_folds == 1 else "paper_prompt_fold"}
    assert {r["fold_id"] for r in rows} == set(range(1, n_folds + 1))
    assert summary.first()["n_valid"] == len(rows)


def test_matrix_run_falls_back(numbers):
    full = numbers.where("k < 20").select("k", "x", "hot", "y")
    holed = inject.mcar_column(full, 0.2, "y", ["k"])
    detail, _ = impute_by_matrix(
        full, holed, ["k"], "y", ["x", "hot", "y"], lambda ps: ["no"] * len(ps), "Demo",
        batch_row=8, factors=["x", "hot"])
    got = detail.join(full, "k").collect()
    assert len(got) == 4 and all(r["prediction"] == r["x"] * r["hot"] for r in got)
    assert {r["source"] for r in got} == {"fallback_product"}
    with pytest.raises(ValueError):
        impute_by_matrix(full, full, ["k"], "y", ["x", "y"], lambda ps: ps, "Demo")


def test_all_rows_by_default_and_first_answers_are_no_fallback(numbers):
    full = numbers.where("k < 60").select("k", "y")
    holed = inject.mcar_column(full, 0.25, "y", ["k"])
    detail, summary = impute_by_matrix(full, holed, ["k"], "y", ["k", "y"], _fills(2), "Demo", batch_row=16)
    assert detail.count() == holed.where("y is null").count()
    assert summary.first()["fallback_rate"] == 0.0


def test_column_blocks_and_their_notes(numbers):
    """Blocks of two columns; one row is never answered and halves its blocks down to itself."""
    full = numbers.where("k < 40").select("k", "y", "x")
    holed = inject.mcar_column(full, 0.25, "y", ["k"])
    never = holed.where("y is null").agg({"k": "min"}).first()[0]

    def scorer(prompts):
        out = []
        for p in prompts:
            head, *rows = p.split("Matrix:\n    ")[1].split("\n\n    Output Format")[0].split("\n")
            cells = [r.split()[1:] for r in rows]
            if "y" in head.split():
                cells = [[k, ("?" if int(k) == never else str(int(k) / 10)) if y == "NaN" else y] for k, y in cells]
            out.append("\n".join([",".join(head.split()), *[",".join(c) for c in cells]]))
        return out

    detail, _ = impute_by_matrix(full, holed, ["k"], "y", ["k", "y", "x"], scorer, "Demo", batch_row=16, batch_col=2)
    rows = {r["k"]: r for r in detail.collect()}
    assert len(rows) == holed.where("y is null").count()
    assert all(r["prediction"] == pytest.approx(k / 10) and r["error"] is None for k, r in rows.items() if k != never)
    lost = rows[never]
    assert lost["source"] != "paper_prompt" and lost["error"] == f"r{never}-{never + 1}:target_open(1)"
    assert lost["notes"].startswith("column_blocks(2/3) | r0-16:target_open(1)") and "half(" in lost["notes"]
    assert all(r["notes"] == "column_blocks(2/3)" for k, r in rows.items() if k >= 16)
    with pytest.raises(ValueError):
        impute_by_matrix(full, holed, ["k"], "y", ["k", "y"], scorer, "Demo", batch_col=0)


def test_only_the_chosen_reading_is_built(spark):
    """Readings are weighed by the widths of their rows: no body of cells stands in the choice."""
    df = spark.createDataFrame([(0, 2, "a,b\n1,x\n2,y")], "batch_id long, n_rows long, response string")
    parsed = matrix.parse_matrix_responses(df, 2)
    assert parsed.first()["parsed"]["body"] == [["1", "x"], ["2", "y"]]
    weighed = [line for line in parsed._jdf.queryExecution().optimizedPlan().toString().split("\n") if "array_min" in line]
    assert len(weighed) == 1 and "array_repeat" not in weighed[0]
