import pytest
from pyspark.sql import types as T

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"

#: nulls, empty and blank texts, ties, repeated rows, a very long text, surrogate-plane characters
LONG = "lorem ipsum dolor sit amet " * 6000
ODD = [
    (1, "the quick brown fox jumps over the lazy dog and runs away from it", "en", "a", 10),
    (1, "the quick brown fox jumps over the lazy dog and runs away from it", "en", "a", 10),
    (2, "The quick brown fox jumps over the lazy dog, and runs away from it!", None, "a", None),
    (3, "", "en", None, 0), (4, None, None, None, None), (5, " \n\t ", "en", "b", 4), (None, "no id at all here", "en", "b", 1),
    (6, "é😀ß " * 40, "xx", "b", 200), (7, LONG, "la", "b", len(LONG)), (8, LONG, "la", "c", len(LONG)), (9, "a", "en", "b", 1), (10, "x" * 4000, "en", "b", 4000),
]


@pytest.fixture(scope="session")
def odd(spark):
    """The odd rows with further columns whose names the operators use themselves."""
    schema = T.StructType([*T.StructType.fromDDL(DOCUMENTS).fields, *[T.StructField(c, T.StringType()) for c in ("node", "score", "spans", "bucket", "tk", "row", "label", "w", "kept")]])
    return spark.createDataFrame([(*r, *["z"] * 9) for r in ODD], schema)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCUMENTS)


def by_id(df, key="doc_id"):
    return {r[key]: r.asDict() for r in df.collect()}
