import random

import pytest

#: A clashing name for every operator's own columns.
EXTRA = ["size", "key", "kept", "h", "n_words", "component_id", "score", "x", "pool"]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and very long texts, ties and repeated rows, extra columns with clashing names."""
    long = " ".join(f"w{i % 997}" for i in range(60_000))
    rows = [(1, "a b c d e f g h i j k", "en", "s1"), (1, "a b c d e f g h i j k", "en", "s1"), (2, "", "en", None), (3, None, None, "s1"), (None, "x y z", "en", "s2"), (4, long, "de", "s2"), (5, long, "de", "s2"), (6, " \n\t ", None, None), (7, "ß" * 5000, "de", "s1"), (8, "A B c d e f g h i j K", "en", "s2")]
    out = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    for c in EXTRA:
        from pyspark.sql import functions as F

        out = out.withColumn(c, F.lit("clash"))
    return out


@pytest.fixture
def rng():
    return random.Random(5)
