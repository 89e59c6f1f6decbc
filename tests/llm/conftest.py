import pytest
from pyspark.sql import types as T
from tests_llm_rows import doc, prose

DOCS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        # Names that operators use themselves.
        *[T.StructField(n, T.StringType()) for n in ("part", "size", "dest", "cid", "bucket", "piece", "score", "id", "component_id", "target", "label")],
    ]
)


@pytest.fixture(scope="session")
def make(spark):
    return lambda rows: spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in every column, empty and very long texts, ties, repeated rows."""
    long = prose(30_000, 1)
    a = prose(120, 2)
    return [
        doc(1, a), doc(2, a), doc(2, a), doc(3, a.upper()), doc(4, None), doc(5, ""), doc(6, " \n\t "), doc(7, "one two"), doc(8, "one  two"), doc(9, long), doc(10, long + " tail"),
        doc(11, "x" * 5_000), doc(12, "ééé ñandú 漢字 \U0001f600 ▁ end"), doc(13, a, None, None), (None, a, None, None, None, *[None] * 11), (14, None, None, None, None, *[None] * 11), doc(-5, "minus " + a),
    ]
