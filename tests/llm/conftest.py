from __future__ import annotations

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs_of(spark, tmp_path):
    """Documents of (doc_id, text[, source]) as a Parquet table with columns that clash with names of results."""
    made = []

    def make(rows, files=2):
        from pyspark.sql import functions as F

        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", None) for r in rows]
        df = spark.createDataFrame(full, DOCS)
        for c in ("score", "size", "ids", "key", "token", "row", "n", "digest", "copies"):
            df = df.withColumn(c, F.lit("x"))
        path = f"{tmp_path}/docs-{len(made)}"
        made.append(path)
        df.repartition(files).write.parquet(path)
        return spark.read.parquet(path)

    return make
