import os

import pytest
from pyspark.sql import types as T

DOCUMENTS = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())]
)


@pytest.fixture
def documents(spark):
    """Makes a documents table from (doc_id, text[, lang[, source]]) tuples."""

    def make(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s0", len(r[1]) if r[1] is not None else None) for r in rows]
        return spark.createDataFrame(full, DOCUMENTS)

    return make


@pytest.fixture
def folder(tmp_path):
    """Writes documents (and labels) where a query reads them."""

    def write(docs, labels=None):
        docs.coalesce(2).write.parquet(os.path.join(tmp_path, "documents.parquet"))
        if labels is not None:
            labels.coalesce(1).write.parquet(os.path.join(tmp_path, "labels.parquet"))
        return str(tmp_path)

    return write
