import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


def document(doc_id, text, lang="en", source="s1"):
    return (doc_id, text, lang, source, None if text is None else len(text))


LINES = [" ".join(f"w{i}x{j}" for j in range(9)) for i in range(12)]
LONG = " ".join(f"word{i % 977}" for i in range(30_000))
ODD = [
    document(1, None), document(2, ""), document(3, " \t\n\x0b\x0c\r"), document(4, "one two"), document(5, "one two three four"),
    document(6, "\n".join(LINES[:5])), document(7, "\n".join(LINES[1:6])), document(7, "\n".join(LINES[1:6])), document(None, "\n".join(LINES[1:6])),
    document(8, "\n".join(LINES[1:6]) + " "), document(9, LONG), document(10, LONG + " end"), document(11, "Größe: ñandú 日本 😀 " * 8), document(None, None, None, None),
    document(12, "\n\n".join(LINES[6:10]), None, None), document(13, "a b c d e f g h " * 5), document(14, "x"), document(15, "\n".join([LINES[11]] * 7)),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and very long texts, repeated rows, equal texts, and columns the operators also use."""
    docs = spark.createDataFrame(ODD, SCHEMA)
    for name in ("shard", "slot", "score", "kept", "n_removed", "ids", "shingles", "bucket_len", "n", "h1", "at", "key", "license", "start"):
        if name not in ("shard", "slot"):
            docs = docs.selectExpr("*", f"doc_id AS {name}")
    return docs


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
