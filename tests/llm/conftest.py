import random

import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n, words=None):
    words = words or [a + b for a in "ta ne so ri mu ka".split() for b in "lo vi den rash tor um".split()]
    return " ".join(rng.choice(words) for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in every column, empty, blank and very long texts, ties and repeated rows."""
    rng = random.Random(5)
    long = "\n".join(prose(rng, 40) for _ in range(2500))
    rows = [(1, None, "en", "a", None), (2, "", "en", "a", 0), (3, "  \n\t\n ", None, "b", 6), (None, prose(rng, 30), "en", None, None), (None, None, None, None, None)]
    rows += [(4, "one", "en", "a", 3), (4, "one", "en", "a", 3), (5, "one", "de", "a", 3), (6, long, "en", "c", len(long)), (7, "é" * 20 + " ünï 日本 🙂 " + prose(rng, 12), "fr", "a", 60)]
    same = prose(rng, 70)
    rows += [(i, same, "en", "a", len(same)) for i in range(10, 16)]
    rows += [(i, prose(rng, 60) + "\n" + same, "en", "a", 0) for i in range(20, 24)]
    return rows


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    """odd_rows with extra columns named like those that operators add."""
    df = spark.createDataFrame(odd_rows, SCHEMA)
    for c in ("row", "runs", "fp", "k_id", "k_text", "score", "doc", "n", "ids", "base", "candidates", "part", "spans", "items", "keep", "p", "host"):
        df = df.withColumn(c, F.lit("x"))
    return df


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="session")
def folder():
    return "/root/testdata/sf0.001"
