import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

#: Nulls in every column, empty and long texts, ties, repeated rows, columns that clash with names inside the operators.
ROWS = [
    (1, "the quick brown fox jumps over the lazy dog", "a", 1, "x"),
    (2, "the  quick brown fox jumps over the lazy dog", "a", 2, "y"),
    (2, "the  quick brown fox jumps over the lazy dog", "a", 2, "y"),
    (None, "the quick brown fox jumps over the lazy dog", None, None, None),
    (3, None, "b", 3, "z"),
    (4, "", "b", 4, "z"),
    (5, " \n\t", None, 5, "z"),
    (6, "word", "b", 6, "z"),
    (7, "Word", "b", 7, "z"),
    (8, "ab " * 20000, "c", 8, "z"),
    (9, "x" * 50000, "c", 9, "z"),
    (10, "mail me at a.b@c.de or +1 (724) 555-7058, 10.0.0.1 é漢 4111 1111 1111 1111", "c", 10, "z"),
    (None, None, None, None, None),
]
SCHEMA = "doc_id long, text string, source string, rid long, marks string"


@pytest.fixture(scope="session")
def edge(spark, tmp_path_factory):
    """The edge rows as a table of several files, with more clashing columns."""
    from pyspark.sql import functions as F

    path = str(tmp_path_factory.mktemp("edge") / "documents.parquet")
    df = spark.createDataFrame(ROWS, SCHEMA)
    for name in ("score", "hash", "rest", "row", "copies", "spans", "node", "key", "shard_", "lang", "n_chars", "__rid", "id", "a", "b"):
        df = df.withColumn(name, F.lit("clash"))
    df.repartition(3, "rid").write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def empty(spark, edge):
    return spark.createDataFrame([], edge.schema)


def table(spark, tmp_path, rows, schema="doc_id long, text string", parts=3):
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame(rows, schema).repartition(parts).write.parquet(path)
    return spark.read.parquet(path)
