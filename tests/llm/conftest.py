import uuid

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, ids string, score string"


@pytest.fixture
def filed(spark, tmp_path):
    """Rows written as Parquet and read back, so that they have a content locator."""

    def write(rows, schema=DOCS, files=2):
        path = str(tmp_path / uuid.uuid4().hex)
        spark.createDataFrame(rows, schema).repartition(files).write.parquet(path)
        return spark.read.schema(schema).parquet(path)

    return write


@pytest.fixture
def odd_docs(filed):
    """Nulls in every column, empty and long texts, ties, repeated rows and clashing column names."""
    long = "word " * 30_000 + "end"
    rows = [
        (1, "The cat sat on the mat. " * 20, "en", "a", 1, "x", "y"),
        (2, "The cat sat on the mat. " * 20, "en", "a", 1, None, None),
        (2, "The cat sat on the mat. " * 20, "en", "a", 1, None, None),
        (3, None, None, None, None, None, None),
        (4, "", "en", "b", 0, "", ""),
        (None, "a text without an id", "en", "b", 9, "", ""),
        (5, long, "en", "c", len(long), "", ""),
        (6, "x" * 5000, "en", "c", 5000, "", ""),
        (7, "\t \n", "en", None, 3, "", ""),
        (8, "émile ² 🙂 \u2028 tail", "fr", "b", 3, "", ""),
    ]
    return filed(rows)
