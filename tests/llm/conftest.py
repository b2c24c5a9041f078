import pytest
from pyspark.sql import functions as F

#: names the operators use themselves; they must not mind them
CLASHING = ("n", "size", "mark", "node", "label", "length", "kept", "target", "digest", "_copies", "key", "bucket", "score", "value", "spans")
LONG = " ".join(f"word{i % 997} other{i % 31}" for i in range(20_000))
PROSE = " ".join(f"alpha{i} beta{i * 7 % 100} gamma{i}" for i in range(60))
ROWS = [
    (1, "Hello World, this is the first text of all.", "en", "b"), (1, "Hello World, this is the first text of all.", "en", "b"),
    (2, "hello  World, this is the first\ttext of all.\n", "en", "a"), (3, None, "en", "a"), (4, "", None, "a"), (5, " \n\t ", "de", None),
    (6, LONG, "en", "c"), (7, LONG + " tail", "en", "c"), (8, LONG, "fr", None), (None, "a text without id", "en", "a"), (None, None, None, None),
    (9, "one two", "en", "a"), (10, "ONE  two", "en", "b"), (11, PROSE, "en", "d"), (12, PROSE.replace("gamma5 ", "delta "), "en", "d"),
    (13, PROSE + "\n" + PROSE, "en", "d"), (14, "\x1c odd \x85 spaces here 　 and 日本語 😀", "ja", "e"),
]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and long texts, ties, repeated rows, and extra columns with clashing names."""
    df = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string")
    return df.select("*", *[F.lit("x").alias(c) for c in CLASHING])


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)
