"""Random indexing against a plain count, gradients, calibration, held-out accuracy, edge cases."""

from __future__ import annotations

import random
import zlib

import numpy as np

from tillframe.llm import quality as q


def corpus(n=600, seed=2):
    rng = random.Random(seed)
    words = [f"{a}{b}" for a in ("ro", "mi", "ta", "ne") for b in ("ka", "so", "ren", "tin", "mel")]
    rows, labels = [], []
    for i in range(n):
        text = [rng.choice(words) for _ in range(rng.randrange(8, 80))]
        good = int(rng.random() < 0.8)
        if not good:
            junk = rng.choice(["###", "|", "!!"])
            text = [f"{w}{junk}" if junk != "!!" else f"{w.upper()}!!" for w in text]
        rows.append((i, " ".join(text) + "."))
        labels.append((i, good, 0))
    return rows, labels


def test_context_sums_by_definition():
    rng = np.random.default_rng(1)
    docs = [rng.integers(0, q.BUCKETS, n) for n in (0, 1, 2, 3, 50)]
    want = np.zeros((q.BUCKETS, q.DIM))
    for d in docs:
        for i in range(len(d)):
            for j in range(len(d)):
                if 0 < abs(i - j) <= q.NEIGHBOURHOOD:
                    want[d[i]] += q.INDEX[d[j]]
    assert np.allclose(q.context_sums(docs), want)


def test_learns_and_holds_out(spark, docs):
    rows, labels = corpus()
    fold = {i: zlib.crc32(str(i).encode()) % 5 for i, _ in rows}
    # Wrong labels on held-out rows must not change anything.
    wrong = [(i, 1 - g if fold[i] == 0 else g, t) for i, g, t in labels]
    schema = "doc_id long, quality int, toxic int"
    extra = [(700, None), (701, ""), (702, "roka " * 150_000), (None, "roka miso."), (0, rows[0][1])]
    df = docs(rows + extra, clashing=True)
    got = q.score_quality(df, spark.createDataFrame(labels + [(None, 0, 0), (9999, 1, 0), (3, None, 0)], schema)).collect()
    other = q.score_quality(docs(rows + extra), spark.createDataFrame(wrong, schema)).collect()
    assert len(got) == len(rows) + len(extra)
    by = {r.doc_id: r for r in got}
    assert {r.doc_id: r.score for r in other} == {i: r.score for i, r in by.items()}
    truth = {i: g for i, g, _ in labels}
    held = [by[i] for i in truth if fold[i] == 0]
    assert all(r.held_out for r in held) and np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.95
    assert abs(np.mean([r.score for r in held]) - np.mean([truth[r.doc_id] for r in held])) < 0.08
    assert by[700].score == by[701].score and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)


def test_one_label_or_none(spark, docs):
    schema = "doc_id long, quality int, toxic int"
    df = docs([(1, "a b"), (2, "c")])
    for labels, score in (([], 0.5), ([(1, 1, 0), (2, 1, 0)], 1.0), ([(1, 0, 0), (2, 0, 0)], 0.0)):
        got = q.score_quality(df, spark.createDataFrame(labels, schema)).collect()
        assert all(abs(r.score - score) < 1e-6 for r in got)
    assert q.score_quality(df.where("doc_id < 0"), spark.createDataFrame([], schema)).count() == 0


def test_temperature_softens_overconfidence():
    rng = np.random.default_rng(3)
    x = rng.standard_normal((400, 6))
    y = (rng.random(400) < 1 / (1 + np.exp(-x[:, 0]))).astype(float)
    network = q.fit_network(x, y, np.ones(400))
    assert network.temperature > 1  # noisy labels, a network that learns them by heart
