"""The pipeline as a whole on an empty table, and on rows with nulls, repeats and clashing columns."""

from __future__ import annotations

import corpus_pipeline
from tests.llm.conftest import CLASHING


def folder_of(spark, path, docs, labels=(), bench=()):
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(list(bench), "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def test_empty_tables(spark, docs, tmp_path):
    folder = folder_of(spark, tmp_path, docs([(1, "a")]).where("doc_id > 1"))
    assert corpus_pipeline.run(spark, folder).count() == 0


def test_nulls_repeats_and_clashing_columns(spark, docs, tmp_path):
    texts = {i: " ".join(f"w{i}x{k}" for k in range(30)) for i in range(12)}
    rows = [(i, t, f"s{i % 2}") for i, t in texts.items()] + [(20, texts[0], "s0"), (None, "no id here " + " ".join(f"n{k}" for k in range(30)), None), (21, None, "s1"), (22, "", "s1")]
    rows += [(30, " ".join(f"b{k}" for k in range(30)) + " Who wrote Faust? Goethe did", "s0")]
    df = docs(rows, clashing=True)
    for name in CLASHING:
        assert name in df.columns
    folder = folder_of(spark, tmp_path, df, [(i, 1, 0) for i in range(6)], [(1, "Who wrote Faust? Goethe"), (2, None)])
    got = corpus_pipeline.run(spark, folder).collect()
    ids = {r.doc_id for r in got}
    assert {0, 2, 4} <= ids and not {20, 30} & ids and None in ids  # the copy and the leak go
    for shard in {r.shard for r in got}:
        slots = sorted(r.slot for r in got if r.shard == shard)
        assert slots == list(range(len(slots)))
