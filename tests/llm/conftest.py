import pytest


def rows_of(df):
    return [tuple(r) for r in df.collect()]


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Nulls, empty, spaces, repeated rows and columns with the operators' inner names."""
    texts = [(1, "a b c"), (2, None), (3, ""), (None, "a b c"), (4, " "), (5, "x" * 50_000),
             (6, "é ▁ b  c "), (6, "é ▁ b  c "), (7, "a\n\nb\t c"), (None, None),
             (8, "<s> a</s> <|endoftext|> b"), (9, "one two  three   four ")]
    return spark.createDataFrame(
        [(i, t, "x", 1, 2, "u", 3) for i, t in texts],
        "doc_id long, text string, _cell string, shard int, n long, unit string, slot int")


@pytest.fixture(scope="session")
def no_documents(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
