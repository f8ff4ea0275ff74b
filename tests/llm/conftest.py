import random

import pytest
from pyspark.sql import types as T

DOCS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from ``(doc_id, text)`` pairs, dealt over several tasks."""

    def make(rows, parts=5):
        full = [(i, t, "en", "src0", None if t is None else len(t)) for i, t in rows]
        return spark.createDataFrame(full, DOCS).repartition(parts)

    return make


@pytest.fixture(scope="session")
def words():
    rng = random.Random(5)
    return ["".join(rng.choice(["th", "er", "on", "an", "re", "he", "in", "ed"]) for _ in range(rng.randint(1, 4))) for _ in range(400)]


# Nulls, empty and white texts, a repeated row, a repeated id with another text, a null id, a long text.
ODD = [(1, None), (2, ""), (3, " \t\n "), (4, "One line\n\nTwo"), (4, "One line\n\nTwo"), (5, "a"), (5, "b"), (None, "no id"), (6, "É \x1c é x"), (7, "word " * 30000)]


@pytest.fixture
def odd():
    return list(ODD)
