from __future__ import annotations

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Nulls, an empty text, repeated rows, two texts under one identifier, near copies, a long text without white space.
BASE = " ".join(f"word{i}" for i in range(60))
NEAR = BASE.replace("word59", "other")
ROWS = [
    (1, BASE, "en", "a", 10),
    (1, BASE, "en", "a", 10),
    (2, NEAR, "en", None, None),
    (3, None, None, None, None),
    (4, "", "en", "a", 0),
    (5, "   \n \t", "en", "a", 5),
    (6, "x" * 5000, "en", "a", 5000),
    (None, "a text without an identifier", "en", "a", 1),
    (7, BASE, "fr", "b", 10),
    (7, "quite another text under the same identifier", "fr", "b", 10),
    (8, "été à l'École\n" + BASE, "fr", "b", 1),
]


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="session")
def clashing(docs):
    """The same rows with columns named as operators name theirs."""
    from pyspark.sql import functions as F

    names = ("id", "node", "digest", "body", "__text", "kept", "score", "ids", "length", "rank", "sequence_id", "n_words", "bands", "at", "item", "start")
    return docs.select("*", *[F.lit(0).alias(n) for n in names])


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
