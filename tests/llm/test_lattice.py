"""Lattice decoding, recall against brute force, links counted once, defined edge cases."""

from __future__ import annotations

import itertools
import math

import numpy as np

from tillframe.llm import lattice

SCHEMA = "vec_id long, embedding array<float>, label int"


def test_nearest_point_is_nearest():
    rng = np.random.default_rng(1)
    x = rng.normal(0, 1.5, (400, 8))
    points = lattice.nearest_e8(x)
    doubled = 2 * points
    whole = doubled % 2 == 0
    assert (whole.all(1) | (~whole).all(1)).all() and (np.round(points.sum(1)) % 2 == 0).all()
    far = ((x[:, None, :] - points[:, None, :] - lattice.NEIGHBOURS) ** 2).sum(2).min(1)
    assert (((x - points) ** 2).sum(1) <= far + 1e-12).all()
    assert len(lattice.NEIGHBOURS) == 240 and np.allclose((lattice.NEIGHBOURS**2).sum(1), 2)


def vectors(n=60, dim=24, seed=3):
    rng = np.random.default_rng(seed)
    rows = []
    for _ in range(n):
        base = rng.standard_normal(dim)
        for _ in range(rng.integers(1, 6)):
            rows.append((len(rows) * 2 + 5, (base + rng.standard_normal(dim) * rng.choice([0.0, 0.05, 0.2])).astype(np.float32).tolist(), int(rng.integers(3))))
    return rows


def brute(rows, threshold=lattice.COSINE):
    def sound(v, label):
        return label is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)

    n = len(rows)
    unit = [np.array(v, float) / np.linalg.norm(np.array(v, float)) if sound(v, b) else None for _, v, b in rows]
    label = list(range(n))
    links = [0] * n

    def find(k):
        while label[k] != k:
            k = label[k]
        return k

    for i, j in itertools.combinations(range(n), 2):
        u, v = unit[i], unit[j]
        if u is not None and v is not None and rows[i][2] == rows[j][2] and len(u) == len(v) and u @ v >= threshold:
            links[i] += 1
            links[j] += 1
            label[find(i)] = find(j)
    smallest = {}
    for k, (i, _, _) in enumerate(rows):
        if i is not None:
            smallest[find(k)] = min(smallest.get(find(k), i), i)
    return sorted(((rows[k][0], links[k], smallest.get(find(k)), rows[k][0] == smallest.get(find(k))) for k in range(n)), key=repr)


def got(df, **options):
    return sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in lattice.near_vectors(df, **options).collect()), key=repr)


def test_equals_brute_force(spark):
    rows = vectors()
    rows += [rows[0], (9001, rows[0][1], rows[0][2]), (9002, rows[0][1], 7), (9003, [2 * x for x in rows[0][1]], rows[0][2])]
    rows += [(8000 + k, v, 1) for k, v in enumerate([None, [], [0.0] * 24, [1.0, None], [float("nan")] * 24, [float("inf")] + [0.0] * 23, [1.0], [2.0], [1.0, 0.0]])]
    rows += [(8100, rows[3][1], None), (8101, rows[3][1], None)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    for name in ("key", "cells", "id", "n", "first", "copies"):
        df = df.withColumn(name, df.vec_id)
    assert got(df, tables=12, probes=8) == brute(rows)  # enough tables to miss no pair at this size


def test_vector_without_id(spark):
    rows = [(1, [1.0, 0.0], 1), (None, [1.0, 0.01], 1), (None, [0.0, 1.0], 1)]
    assert got(spark.createDataFrame(rows, SCHEMA)) == brute(rows)


def test_dense_group_is_counted_in_blocks(spark):
    rng = np.random.default_rng(5)
    base = rng.standard_normal(16)
    rows = [(k, (base + rng.standard_normal(16) * 0.02).astype(np.float32).tolist(), 1) for k in range(300)]
    assert got(spark.createDataFrame(rows, SCHEMA).repartition(4), block=40) == brute(rows)


def test_recall_at_the_threshold():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((3000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = rng.standard_normal((3000, 64))
    y -= (y * x).sum(1, keepdims=True) * x
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    for cosine, least in ((0.9301, 0.9), (0.95, 0.95), (0.98, 0.995)):
        a, b = lattice.cells(x), lattice.cells(cosine * x + math.sqrt(1 - cosine**2) * y)
        assert (a[:, :, None] == b[:, None, :]).any((1, 2)).mean() >= least


def test_empty_table(spark):
    assert lattice.near_vectors(spark.createDataFrame([], SCHEMA)).count() == 0
