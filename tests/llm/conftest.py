import pytest

#: Cases that every operator must take: nulls, empty and long texts, ties, repeated rows, a clashing extra column.
ODD = [
    (1, None), (2, ""), (3, "\n\n"), (4, "x" * 30_000), (5, "one two three"), (5, "one two three"), (6, "  lead and trail  \n"),
    (None, "a document without an id but with some words in it"), (7, "word " * 4000), (8, "0123456789 " * 300), (9, "é𝒳 ü\x85ñ\u3000z"),
    (10, "0" * 5000 + "1.1.1.1"), (11, "iVBORw0KGgo" * 4000 + "="),
]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame([(i, t, "n", 0) for i, t in ODD], "doc_id long, text string, rep string, path long")


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, rep string, path long")


@pytest.fixture(scope="session")
def docs(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet")
