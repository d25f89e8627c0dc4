"""The threshold algorithm against plain scores; whole tables against brute force; defined edge cases."""

from __future__ import annotations

import math

import duckdb
import numpy as np
import pytest

from tillframe.llm import negatives, queries

SCHEMA = "vec_id long, label int, embedding array<double>"


@pytest.mark.parametrize("seed", range(20))
def test_scan_equals_plain_scores(seed):
    rng = np.random.default_rng(seed)
    size, dim = int(rng.integers(1, 300)), int(rng.integers(1, 9))
    values = rng.integers(-6, 7, (size, dim)) * int(rng.choice([1, 1 << 26]))
    lists = np.argsort(values, axis=0, kind="stable").T
    anchor = rng.integers(-5, 6, dim) * int(rng.choice([0, 1, 1, 1 << 26]))
    eligible = rng.random(size) < 0.7
    scores = values @ anchor
    edges = [int(v) for v in rng.choice(scores, 2)]
    windows = [negatives.ANY, (min(edges), max(edges)), (5, 4), (max(edges), max(edges))]
    for k in (1, 3):
        for (low, high), (rows, got) in zip(windows, negatives.scan(values, lists, anchor, eligible, windows, k)):
            inside = [(-int(scores[r]), r) for r in range(size) if eligible[r] and low <= scores[r] <= high]
            kth = sorted(inside)[k - 1][0] if len(inside) >= k else math.inf
            assert sorted(zip((-got).tolist(), rows.tolist())) == sorted(p for p in inside if p[0] <= kth)


def test_scan_stops_before_the_end(monkeypatch):
    """A row far ahead of all others is found without looking at most of the block."""
    values = np.vstack([np.random.default_rng(1).integers(-20, 20, (5000, 6)), np.full((1, 6), 1000)])
    lists = np.argsort(values, axis=0, kind="stable").T

    class Counted(np.ndarray):
        looked = 0

        def __getitem__(self, key):
            out = super().__getitem__(key)
            if isinstance(key, tuple) and isinstance(key[1], slice):
                Counted.looked += out.size
            return out

    rows, _ = negatives.scan(values, lists.view(Counted), np.ones(6, np.int64), np.ones(5001, bool), [negatives.ANY], 1)[0]
    assert rows.tolist() == [5000] and Counted.looked <= 6 * negatives.FIRST_STEP


def test_window():
    for p in range(-50, 300):
        low, high = negatives.window_of(p)
        assert [s for s in range(-200, 400) if 50 * p <= 100 * s <= 95 * p] == list(range(low, high + 1))


def brute(rows, relabel=False):
    good = [(i, b, v) for i, b, v in rows if i is not None and b is not None and v and all(c is not None and math.isfinite(c) for c in v)]
    good = [(i, (b + 1) % 10 if relabel and i % 7 == 0 else b, [math.floor(256 * c) for c in v]) for i, b, v in good]
    out = []
    for a, (i, b, v) in enumerate(good):
        if i % 50:
            continue
        scored = [(-sum(x * y for x, y in zip(v, w)), j, c) for k, (j, c, w) in enumerate(good) if k != a and len(w) == len(v)]
        for s, p, _ in sorted(t for t in scored if t[2] == b)[:5]:
            windowed = sorted(t for t in scored if t[2] != b and 50 * -s <= 100 * -t[0] <= 95 * -s)
            out += [(i, p, r + 1, j, -s, -t) for r, (t, j, _) in enumerate(windowed[:3])]
    return sorted(out)


def collected(df):
    return sorted((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in df.collect())


def vectors(n=700, dim=12, seed=2):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((9, dim))
    rows = []
    for i in range(n):
        label = int(rng.integers(6)) if i % 3 else 2  # a label with a third of all rows
        rows.append((i, label, (centres[label + i % 4] / 4 + rng.standard_normal(dim) * rng.choice([0.01, 0.2])).tolist()))
    return rows


@pytest.mark.parametrize("options", [{}, {"block_rows": 50, "pack": 3, "packs": 2}])
def test_table_equals_brute_force(spark, options):
    from pyspark.sql import functions as F

    rows = vectors()
    rows += [rows[50], rows[50], (1001, 2, rows[100][2]), (1002, 1, rows[100][2]), (1050, 2, [0.0] * 12), (1100, 77, rows[3][2])]
    rows += [(1150, 2, [1.0, 2.0]), (1151, 2, [1.0, 1.0]), (1152, 3, [0.5, 0.5]), (1153, 3, [0.9, 0.9]), (None, 2, rows[0][2]), (1200, None, rows[0][2])]
    rows += [(1250 + 50 * k, 2, v) for k, v in enumerate([None, [], [None] * 12, [float("nan")] * 12, [float("inf")] * 12])]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    for name in ("place", "dim", "x", "block", "n", "score", "asks", "rank"):
        df = df.withColumn(name, df.vec_id * 0 + 9)
    want = brute(rows)
    assert want and {r[0] for r in want} >= {50, 1150}
    assert collected(negatives.mine_negatives(df, F.col("vec_id") % 50 == 0, **options)) == want


def test_many_equal_vectors(spark):
    from pyspark.sql import functions as F

    rows = [(i, i % 3, [0.5, -0.25]) for i in range(400)] + [(1000 + i, 5, [0.4, -0.2]) for i in range(300)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert collected(negatives.mine_negatives(df, F.col("vec_id") % 50 == 0, block_rows=64)) == brute(rows)


def test_no_rows(spark):
    from pyspark.sql import functions as F

    for rows in ([], [(1, 1, [1.0])], [(50, 1, [1.0])], [(50, None, [1.0]), (100, 1, None)]):
        assert negatives.mine_negatives(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 50 == 0).count() == 0


def test_given_vectors(spark):
    folder = "/root/testdata/sf0.001"
    rows = duckdb.sql(f"SELECT vec_id, label, embedding FROM '{folder}/embeddings.parquet'").fetchall()
    assert collected(queries.op13_negatives(spark, folder)) == brute(rows, relabel=True)
