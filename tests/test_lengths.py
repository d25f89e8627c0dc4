from __future__ import annotations

import collections
import math
import random

import pytest
from pyspark.sql import functions as F

from tillframe.functions import lengths
from tillframe.functions.lengths import hashed, squared_lengths


def terms(words):
    return [*words, *(f"{a} {b}" for a, b in zip(words, words[1:]))]


def plain(texts, elsewhere, total):
    """Squared lengths by key; every text counts once per term, the texts of a key make one length."""
    df, tf = collections.Counter(elsewhere), collections.defaultdict(collections.Counter)
    for doc, words in texts:
        df.update(set(terms(words)))
        tf[doc].update(terms(words))
    idf = {t: math.log((1 + total) / (1 + n)) + 1 for t, n in df.items()}
    return {doc: sum((n * idf[t]) ** 2 for t, n in counts.items()) for doc, counts in tf.items()}


def measured(spark, texts, elsewhere, total, chars, share_chars):
    rows = spark.createDataFrame(texts, "doc long, words array<string>")
    grouped = rows.groupBy("doc").agg(F.collect_list("words").alias("texts")).sortWithinPartitions("doc")
    listed = grouped.select("doc", F.transform("texts", hashed).alias("texts"))
    others = spark.createDataFrame(list(elsewhere.items()), "term string, members long")
    others = others.select(hashed(F.split("term", " ")).alias("tokens"), "members")
    found = squared_lengths(listed, others, total, chars, share_chars).collect()
    assert len({r.doc for r in found}) == len(found)
    return {r.doc: r.ww for r in found}


@pytest.mark.parametrize("shares", [1, 7, 300])
def test_lengths_equal_plain_counts(spark, shares):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(60)]
    texts = [(i, [rng.choice(words[: 3 + i % 58]) for _ in range(i % 40)]) for i in range(200)]
    # A key with several texts, a null key with two, 300 equal words, a word in front of itself.
    texts += [(7, ["w1", "w2", "w1"]), (7, ["w2"]), (None, ["w3"]), (None, ["w3", "w4"]), (900, ["w5"] * 300), (901, ["w9", "w9"])]
    elsewhere = {"w1": 70_000, "w1 w2": 3, "w2 w1": 400, "nowhere": 2}
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "13")
    try:
        got = measured(spark, texts, elsewhere, 100_000, shares * 10, 10)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    want = {doc: ww for doc, ww in plain(texts, elsewhere, 100_000).items() if ww or doc in got}
    assert got.keys() == want.keys()
    assert all(math.isclose(got[doc], ww, rel_tol=1e-12) for doc, ww in want.items())


def test_no_texts_and_no_others(spark):
    assert measured(spark, [], {"w1": 2}, 5, 0, 10) == {}
    assert measured(spark, [(1, []), (2, [])], {}, 5, 30, 10) == {}
    assert measured(spark, [(1, ["a1"])], {}, 1, 30, 10) == {1: 1.0}


def test_batches_of_many_words_are_cut_between_texts():
    import pyarrow as pa

    word = pa.struct([("key", pa.int64()), ("part", pa.int32())])
    sizes = [3, 0, lengths.BATCH_WORDS, 1, 2]
    one = pa.array([[{"key": 1, "part": 1}] * 3], pa.list_(word)).values
    many = pa.concat_arrays([one] * (sum(sizes) // 3 + 1)).slice(0, sum(sizes))
    ends = [0, *(sum(sizes[: i + 1]) for i in range(len(sizes)))]
    words = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), many)
    texts = pa.ListArray.from_arrays(pa.array(range(len(sizes) + 1), pa.int32()), words)
    batch = pa.RecordBatch.from_pydict({"doc": pa.array(range(len(sizes))), "texts": texts})
    assert [b.column("doc").to_pylist() for b in lengths._cut(iter([batch, batch.slice(0, 0)]))] == [[0, 1, 2], [3, 4]]
