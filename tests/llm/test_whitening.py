"""Inertia counts, contours and components against plain eigenvalues; exact sums; whole tables; defined edge cases."""

from __future__ import annotations

import math
from collections import defaultdict
from fractions import Fraction

import duckdb
import numpy as np
import pytest

from tillframe.llm import queries, whitening

SCHEMA = "vec_id long, embedding array<double>"


def symmetric(values, seed=0):
    values = np.asarray(values, float)
    basis, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((len(values), len(values))))
    matrix = basis @ np.diag(values) @ basis.T
    return (matrix + matrix.T) / 2


SPECTRA = {
    "falling": np.exp(-np.arange(40) / 5),
    "flat": 1 + np.arange(64) / 640,
    "equal": [5.0] * 12 + [3.0] * 20 + [1.0] * 8,
    "close": [2 + 1e-7 * k for k in range(20)] + [1.0] * 20,
    "low rank": [7.0, 3.0, 2.0] + [0.0] * 30,
    "one": [4.0],
    "wide": [1e12, 1e6, 1.0, 0.5, 0.25],
}


@pytest.mark.parametrize("name", SPECTRA)
def test_inertia(name):
    values = np.asarray(SPECTRA[name])
    matrix = symmetric(values, 1)
    for shift in np.r_[(values[1:] + values[:-1]) / 2, values.max() + 1, values.min() - 1]:
        if np.abs(values - shift).min() > 1e-9 * values.max():
            assert whitening.inertia(matrix, shift) == (values > shift).sum()


def test_inertia_needs_pivots_of_two():
    assert whitening.inertia(np.array([[0.0, 1.0], [1.0, 0.0]]), 0.0) == 1
    assert whitening.inertia(np.zeros((3, 3)), 0.0) == 0


@pytest.mark.parametrize("name", SPECTRA)
@pytest.mark.parametrize("count", [1, 5, 16])
def test_components_equal_plain_eigenvectors(name, count):
    values = np.sort(np.asarray(SPECTRA[name]))[::-1]
    matrix = symmetric(values, 2)
    floor = 1e-10 * values.sum()
    got, vectors = whitening.leading(matrix, count, floor)
    count = min(count, int((values > floor).sum()))
    assert len(got) == count
    assert np.allclose(got, values[:count], rtol=1e-12, atol=1e-14 * values[0])
    assert np.abs(vectors.T @ vectors - np.eye(count)).max() < 1e-13
    assert np.abs(matrix @ vectors - vectors * got).max() < 1e-13 * max(1, values[0])


def test_contour_projects_onto_an_interval():
    matrix = symmetric([9.0, 7.0, 6.5, 2.0, 1.0], 3)
    values, axes = np.linalg.eigh(matrix)
    inside = axes[:, (values > 5) & (values < 8)]
    out = whitening.contour(matrix, 5.0, 8.0, np.eye(5), nodes=32)
    assert np.allclose(out, inside @ inside.T, atol=1e-6)


def vectors(n=300, dim=20, seed=4):
    rng = np.random.default_rng(seed)
    mix = rng.standard_normal((dim, dim)) * np.linspace(2, 0.1, dim)
    return [(i, (rng.standard_normal(dim) @ mix).tolist()) for i in range(n)]


def brute(rows, components=16):
    """The contract in plain numbers; whitened columns are squared, for either sign is right."""
    good = [(i, v) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    dim = max((len(v) for _, v in good), default=0)
    cut = [(i, tuple(math.floor(64 * c) + 1_000_000 for c in v)) for i, v in good if len(v) == dim]
    fit = sorted({x for _, x in cut})
    n, sums = len(fit), [sum(x[d] for x in fit) for d in range(dim)]
    centred = np.array([[float(Fraction(v) - Fraction(s, n)) for v, s in zip(x, sums)] for x in fit])
    cov = centred.T @ centred / n
    e, axes = np.linalg.eigh(cov)
    order = np.argsort(-e)[:components]
    out = defaultdict(list)
    for i, x in cut:
        c = np.array([float(Fraction(v) - Fraction(s, n)) for v, s in zip(x, sums)])
        deviation = sum((n * v - s) ** 2 for v, s in zip(x, sums))
        for k, o in enumerate(order):
            if e[o] > 1e-10 * e.sum():
                out[i, k + 1].append((n, deviation, (c @ axes[:, o]) ** 2 / e[o], e[o] / e.sum()))
    return out


def check(df, rows, tolerance=1e-9):
    want, got = brute(rows), defaultdict(list)
    for r in df.collect():
        got[r.vec_id, r.component].append((r.n, r.deviation, r.whitened**2, r.explained))
        assert r.identity_error < 1e-9
    assert got.keys() == want.keys()
    for key, values in want.items():
        assert len(got[key]) == len(values)
        for a, b in zip(sorted(got[key]), sorted(values)):
            assert a[:2] == b[:2] and np.allclose(a[2:], b[2:], rtol=tolerance, atol=tolerance)


def test_rows_equal_plain_numbers(spark):
    rows = vectors()
    rows += [(1, rows[0][1]), (None, rows[5][1]), (900, rows[3][1]), (901, [c + 1e-9 for c in rows[3][1]])]
    bad = [(950, None), (951, []), (952, [None] * 20), (953, [float("nan")] * 20), (954, [float("inf")] * 20), (955, [1.0, 2.0])]
    df = spark.createDataFrame(rows + bad, SCHEMA).repartition(5)
    for name in ("x", "n", "component", "k", "v", "label"):
        df = df.withColumn(name, df.vec_id * 0 - 3)
    check(whitening.whiten(df), rows)


def test_fewer_components_than_asked_for(spark):
    rows = [(i, [float(i % 7), 2.0 * (i % 7), float(i % 3)]) for i in range(30)]  # rank two
    out = whitening.whiten(spark.createDataFrame(rows, SCHEMA))
    assert {r.component for r in out.collect()} == {1, 2}
    check(out, rows)


def test_long_entries_stay_exact(spark):
    rows = [(i, [1e9 * (i % 5), -3e8 * (i % 4), 1e15 * (i == 3)]) for i in range(40)]
    got = {r.vec_id: r.deviation for r in whitening.whiten(spark.createDataFrame(rows, SCHEMA)).collect()}
    want = {i: v[0][1] for (i, _), v in brute(rows).items()}
    assert got == {i: d if d < 1 << 63 else None for i, d in want.items()}
    fit = spark.createDataFrame([([(1 << 60) + i, -(1 << 60), i],) for i in range(100)], "x array<long>").repartition(4)
    n, sums, square = whitening.moments(fit, 3)
    assert (n, sums) == (100, [(100 << 60) + 4950, -(100 << 60), 4950])
    assert square[0][0] == square[0][2] == square[2][2] == 100 * sum(i * i for i in range(100)) - 4950**2 and square[1][1] == 0


def test_no_variance_and_no_rows(spark):
    assert whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.001])], SCHEMA)).count() == 0
    assert whitening.whiten(spark.createDataFrame([], SCHEMA)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, None), (2, [])], SCHEMA)).count() == 0


def test_given_vectors(spark):
    folder = "/root/testdata/sf0.001"
    rows = duckdb.sql(f"SELECT vec_id, embedding FROM '{folder}/embeddings.parquet'").fetchall()
    check(queries.op12_whitening(spark, folder), rows, 1e-7)
