import pytest
from pyspark.sql import types as T


@pytest.fixture
def docs(spark):
    """Nulls, empty and very long texts, ties, repeated rows, and columns whose names clash with the operators' own."""
    words = " ".join(f"w{i}" for i in range(60))
    rows = [
        (1, words, "en", "x"),
        (2, words, "en", "x"),
        (3, words + " tail", None, "x"),
        (4, None, "en", None),
        (5, "", "en", "x"),
        (6, "two words", "en", "x"),
        (7, "It's a test, isn't it? <|endoftext|> é́ ü\x0bend", "fr", "x"),
        (8, "long " * 30_000, "en", "x"),
        (8, "long " * 30_000, "en", "x"),
        (None, words, "en", "x"),
        (9, "Licensed under the Apache License, Version 2.0.\nother words here\nother words here\n \n", "en", "x"),
    ]
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("blob", T.StringType())])
    return spark.createDataFrame(rows, schema)


@pytest.fixture
def empty(docs):
    return docs.where("false")


def texts(df):
    """(doc_id, text) of rows with an id, in order; null is empty."""
    return sorted((r["doc_id"], r["text"] or "") for r in df.where("doc_id is not null").collect())
