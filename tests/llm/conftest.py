from __future__ import annotations

import os

import pytest

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark):
    """Makes a documents table from texts or (doc_id, text, source) rows, with extra columns of awkward names."""

    def make(rows, lang="en"):
        full = []
        for k, row in enumerate(rows):
            doc_id, text, source = (k, row, "s") if row is None or isinstance(row, str) else row
            full.append((doc_id, text, lang, source, len(text or "")))
        df = spark.createDataFrame(full, SCHEMA)
        from pyspark.sql import functions as F

        for name in ("size", "start", "end", "ids", "rank", "fp", "score", "count", "target", "state", "spans", "_n", "kept", "row", "copies", "source_size", "_found", "_keep", "_leaks", "_id", "_gone", "_parts", "n_lines"):
            df = df.withColumn(name, F.lit(name))
        return df

    return make


@pytest.fixture(scope="session")
def folder():
    if not os.path.isdir(FOLDER):
        pytest.skip("no test tables here")
    return FOLDER
