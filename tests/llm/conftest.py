import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("size", T.StringType()), T.StructField("rid", T.StringType()),
    T.StructField("kind", T.StringType()),
])

LONG = " ".join(f"word{i % 977} and{i % 31}" for i in range(30_000))
WORDS = " ".join(f"w{i}" for i in range(120))


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, and columns that clash with the operators' own."""
    rows = [
        (1, "Same text here\nA line that is long enough to count\n", "en", "b", 5, "x", "x", "x"),
        (1, "Same text here\nA line that is long enough to count\n", "en", "b", 5, "x", "x", "x"),
        (2, "Sametext here\n a line that is long enough to count\t", None, "a", None, None, None, None),
        (3, "a LINE that is long enough to count\nother", "en", None, 1, "y", "y", "y"),
        (4, None, "en", "a", 1, "y", "y", "y"),
        (5, "", "en", "a", 1, "y", "y", "y"),
        (None, "", None, None, None, None, None, None),
        (None, "same Text", None, None, None, None, None, None),
        (None, WORDS + " end", None, "c", None, None, None, None),
        (6, WORDS, "en", "c", 1, "y", "y", "y"),
        (7, WORDS + " other end", "en", "c", 1, "y", "y", "y"),
        (8, LONG, "en", "c", 1, "y", "y", "y"),
        (9, "x" * 200_000, "en", "c", 1, "y", "y", "y"),
        (10, " \t\n ", "en", "c", 1, "y", "y", "y"),
        (11, "four words only here", "en", "c", 1, "y", "y", "y"),
        (12, "four words only here", "en", "c", 1, "y", "y", "y"),
        (13, "mail a.b@c.de, call +1 (555) 222-3333, 4111 1111 1111 1111 from 10.0.0.256 or 010.1.2.3 \U0001f600 a@b.c.d", "en", "c", 1, "y", "y", "y"),
        (14, "a" + " " * 1_000_000 + "b" + "\n" * 1_000_000, "en", "b", 1, "y", "y", "y"),
        (15, "".join(f"line number {i} of many lines in one text\n" for i in range(20_000)), "en", "b", 1, "y", "y", "y"),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
