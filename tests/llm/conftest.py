import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark):
    """Makes a documents table from (doc_id, text) pairs."""

    def make(rows):
        return spark.createDataFrame([(i, t, "en", "src", len(t) if t is not None else None) for i, t in rows], DOCS)

    return make


@pytest.fixture(scope="session")
def odd(docs):
    """Nulls, empty and very long texts, repeated rows, and columns whose names clash with the operators' own."""
    from pyspark.sql import functions as F

    long = "word " * 20_000
    rows = [(1, None), (2, ""), (3, "one two three four five six"), (3, "one two three four five six"), (4, long), (None, "x y")]
    frame = docs(rows)
    for name in ("fp", "block", "part", "own", "key", "node", "shard", "leaks", "found", "hits", "order"):
        frame = frame.withColumn(name, F.lit("clash"))
    return frame
