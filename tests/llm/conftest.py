import pytest
from pyspark.sql import functions as F

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make(spark):
    """Documents from (doc_id, text[, lang[, source]]) rows, with extra columns whose names operators use themselves."""

    def of(rows, extra=True):
        full = [(*r, *[None] * (4 - len(r)), len(r[1]) if r[1] is not None else None) for r in rows]
        docs = spark.createDataFrame(full, DOCUMENTS)
        if not extra:
            return docs
        for name in ("code", "key", "size", "begin", "_told", "_key", "Copies", "component", "n", "a.b"):
            docs = docs.withColumn(name, F.lit("x"))
        return docs

    return of


@pytest.fixture(scope="session")
def documents(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark, small):
    return spark.read.parquet(f"{small}/labels.parquet")


@pytest.fixture
def awkward(make):
    """Nulls in every column, empty and long texts, ties and repeated rows."""
    long = " ".join(f"word{i % 997}" for i in range(60_000))
    return make([
        (1, "a b c d e", "en", "s"), (1, "a b c d e", "en", "s"), (2, None, None, None), (3, "", "en", None),
        (None, "one two three four five", "en", "s"), (None, None, None, None), (4, long, "en", "t"), (5, long, "en", "t"),
        (6, " \t\n ", "fr", ""), (7, "éè \U0001f600 ß", "fr", "\U0001f600"), (8, "a b c d e", None, "s"),
    ])
