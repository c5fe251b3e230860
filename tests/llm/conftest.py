from __future__ import annotations

import pytest
from pyspark.sql import types as T

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(spark):
    from stallkeeper.llm.common import tune
    return tune(spark)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


#: Columns that share names with what the operators use inside.
CLASH = ["size", "score", "target", "taken", "shard", "fp", "_key", "_text", "h", "id", "key", "before", "n_rows"]
BASE = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                     T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                     T.StructField("n_chars", T.LongType())])


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from (doc_id, text) or (doc_id, text, source), with clashing extra columns if wanted."""
    def make(rows, clash=False):
        schema = T.StructType([*BASE.fields, *(T.StructField(c, T.StringType()) for c in (CLASH if clash else []))])
        extra = tuple("x" for _ in CLASH) if clash else ()
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "a", len(r[1]) if r[1] is not None else None, *extra) for r in rows]
        return spark.createDataFrame(full, schema)
    return make


#: Null and empty texts, null ids, repeated rows, repeated ids, ties, a very long text, one endless word.
ODD = [(1, None), (2, ""), (3, "  \n\t "), (None, "no id here at all today"), (4, "same row twice over now"),
       (4, "same row twice over now"), (5, "one id"), (5, "two texts"), (6, "word " * 60_000), (7, "x" * 200_000),
       (8, "1" * 100_000), (9, "a.b " * 20_000), (10, "é́ 文字 😀 \x00 \x1c ﬁ")]


@pytest.fixture(scope="session")
def odd(make_docs):
    return make_docs(ODD, clash=True)
