from __future__ import annotations

import pytest

from tillframe.llm.common import prepare

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
# Columns whose names the operators use themselves.
CLASHING = ("fp", "size", "key", "component_id", "target", "shard", "hit", "score", "found", "count")


@pytest.fixture
def docs(spark):
    """Make a documents table from (doc_id, text) or (doc_id, text, source), with clashing columns if asked for."""
    prepare(spark)

    def make(rows, clashing=False):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "src0", len(r[1] or "")) for r in rows]
        df = spark.createDataFrame(full, DOCS).repartition(3)
        if clashing:
            for name in CLASHING:
                df = df.withColumn(name, df.doc_id * 0 - 5)
        return df

    return make
