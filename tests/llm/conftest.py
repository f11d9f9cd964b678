import pytest
from pyspark.sql import types as T

WORDS = "the quick brown fox jumps over a lazy dog while seven wizards brew potions under pale moonlight and sing quietly".split()


def prose(seed: int, n: int) -> str:
    """n words that depend on the seed, some in lines of their own."""
    state, out = seed * 7919 + 13, []
    for i in range(n):
        state = (state * 1103515245 + 12345) % (1 << 31)
        out.append(WORDS[state % len(WORDS)] + str(state // 65536 % 97))
        if state % 11 == 0:
            out.append("\n")
    return " ".join(out).replace(" \n ", "\n")


SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
    T.StructField("n_chars", T.LongType()), T.StructField("rules", T.StringType()), T.StructField("size", T.LongType()), T.StructField("key", T.StringType()),
    T.StructField("id", T.LongType()), T.StructField("score", T.DoubleType()), T.StructField("label", T.IntegerType()), T.StructField("copies", T.LongType()),
])


def row(doc_id, text, source="a"):
    return (doc_id, text, "en", source, len(text or ""), "x", 1, "k", 5, 0.5, 1, 3)


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and white texts, a very long one, copies, repeated rows, ids that come twice, clashing columns."""
    rows = [row(i, prose(i, 60 + 7 * i), "abc"[i % 3]) for i in range(12)]
    rows += [row(20, None), row(21, ""), row(22, " \t\n "), row(None, prose(3, 80)), row(None, None, None), row(23, prose(5, 95), None)]
    rows += [row(30, prose(50, 30_000)), row(31, prose(51, 200)), row(32, prose(51, 200)), row(32, prose(51, 200)), row(4, prose(77, 70))]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def some_labels(spark):
    return spark.createDataFrame([(i, i % 2, (i // 2) % 2) for i in range(12)] + [(3, 1, 1), (5, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
