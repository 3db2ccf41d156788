import zlib

import pytest
from pyspark.sql.types import LongType, StringType, StructField, StructType

SCHEMA = StructType([StructField("doc_id", LongType()), StructField("text", StringType()), StructField("source", StringType())])

#: Null and empty texts, white space only, one and two words, equal texts, a long text, non-ASCII, junk characters.
ODD = [
    (1, None, "a"), (2, "", None), (3, " \t\n ", "a"), (4, "one", "b"), (5, "One  two", "b"), (6, "one two", None),
    (7, "Übung macht den Meister, sagt man in allen Städten und Dörfern des Landes.", "c"),
    (8, "Übung macht den Meister, sagt man in allen Städten und Dörfern des Landes.", "c"),
    (9, "x" * 5000, "a"), (10, " ".join(f"w{i}" for i in range(3000)), "a"), (11, "a b   c\x00d", "b"), (12, "*** ### !!!", "a"),
]


@pytest.fixture()
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture()
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture()
def docs(spark):
    return lambda texts, sources=None: spark.createDataFrame([(i, t, (sources or ["s"] * len(texts))[i]) for i, t in enumerate(texts)], SCHEMA)


def fold(doc_id: int, folds: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % folds
