"""An approximate index of vectors: cells, short codes, and exact scores at the end.

Cells are trained on a sample of bounded size; their number grows with the root
of the table. Each row is stored in its closest cells, as a code of one byte per
stretch of dimensions. A query looks into its closest cells, scores codes by
tables of distances, and compares the best of them exactly. How many cells are
looked into is measured when the index is built: as many as bring the wanted
recall for a bounded sample of its own rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillframe.functions.vectors import SCORE_DIGITS, top_k, unit_rows
from tillframe.sources.storage import materialize

COPIES = 2  # cells that hold a row
RECALL = 0.97  # wanted share of the exact hits for the sample that settles the number of cells looked into
SAMPLE, ASKED = 100_000, 128  # rows that train cells and codes, and that ask while the index is built
CELL_BYTES = 64 << 20  # the centres are handed to every task; there are no more of them than this holds
STRETCH, WORDS = 4, 256  # dimensions per byte of a code, values of a byte
BLOCK = 8192  # codes of a cell that are scored together
TOGETHER = 256  # queries that meet a block of codes in one task
REFINED = 64  # best codes per query whose vectors are compared at least; more, if the sample says so
MOST_REFINED = 1 << 14
ROUNDS, SEED = 8, 7
STEP = 4096  # rows worked on at a time while books are trained


class VectorIndex(NamedTuple):
    """``codes`` (cell, block, id, code), ``vectors`` (id, vec), ``blocks`` (cell, blocks), and what tasks need to read them."""

    codes: DataFrame
    vectors: DataFrame
    blocks: DataFrame
    centres: Broadcast  # a row per cell, of length one
    books: Broadcast  # per stretch of dimensions: the values that a byte stands for
    probes: int
    refined: int
    cells: int


def stacked(column: pd.Series, dim: int) -> np.ndarray:
    return unit_rows(np.vstack(column.to_numpy()).astype(np.float64)) if len(column) else np.zeros((0, dim))


def lloyd(rows: np.ndarray, k: int, seed: int = SEED) -> np.ndarray:
    """At most ``k`` means of ``rows``; all distinct rows if there are no more."""
    distinct = np.unique(rows, axis=0)
    if len(distinct) <= k:
        return distinct
    means = distinct[np.random.default_rng(seed).choice(len(distinct), k, replace=False)]
    for _ in range(ROUNDS):
        half = (means * means).sum(1) / 2
        own = np.concatenate([(rows[a : a + STEP] @ means.T - half).argmax(1) for a in range(0, len(rows), STEP)])
        counts = np.bincount(own, minlength=k)
        sums = np.stack([np.bincount(own, rows[:, d], k) for d in range(rows.shape[1])], axis=1)
        means = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], means)
    return means


def stretches(dim: int) -> list[slice]:
    return [slice(a, min(a + STRETCH, dim)) for a in range(0, dim, STRETCH)]


def encoded(rows: np.ndarray, books: list[np.ndarray]) -> np.ndarray:
    """A byte per stretch: the closest value of its book."""
    parts = [rows[:, s] for s in stretches(rows.shape[1])]
    return np.stack([(p @ b.T - (b * b).sum(1) / 2).argmax(1) for p, b in zip(parts, books)], axis=1).astype(np.uint8)


def closest(rows: np.ndarray, centres: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` cells whose centres are most similar to each row, best first."""
    return np.argsort(-(rows @ centres.T), axis=1, kind="stable")[:, :k]


def _books(sample: DataFrame, dim: int) -> list[np.ndarray]:
    """The values of each stretch, trained by one task per stretch over the bounded sample."""

    def train(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        vecs, own = frame["vec"], stretches(dim)[key[0]]
        rows = np.concatenate([stacked(vecs.iloc[a : a + STEP], dim)[:, own] for a in range(0, len(vecs), STEP)])
        return pd.DataFrame({"s": [key[0]], "values": [lloyd(rows, WORDS).ravel()]})

    each = sample.select("vec", F.explode(F.sequence(F.lit(0), F.lit(len(stretches(dim)) - 1))).alias("s"))
    rows = each.groupBy("s").applyInPandas(train, "s int, values array<double>").collect()  # a row per stretch
    books = {r.s: np.array(r["values"]) for r in rows}
    return [books[k].reshape(-1, s.stop - s.start) for k, s in enumerate(stretches(dim))]


def build_index(vectors: DataFrame, k: int, recall: float = RECALL, cells: int | None = None) -> VectorIndex:
    """Index ``vectors`` (id, vec): ids are unique, all vectors have one length.

    ``recall`` is asked of the ``k`` best rows. Zero vectors are similar to nothing
    and lie in any cell. The table must not be empty.
    """
    spark = vectors.sparkSession
    rows = vectors.select("id", "vec").where(F.col("vec").isNotNull())
    n, dim = rows.agg(F.count("*"), F.max(F.size("vec"))).first()
    norm = F.aggregate("vec", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    chosen = F.pmod(F.xxhash64("id"), F.lit(n)) < SAMPLE
    sample = materialize(rows.where(chosen & (norm > 0)), "index-sample")
    if cells is None:
        cells = round(n**0.5)
    cells = max(2, min(cells, CELL_BYTES // (8 * dim)))
    unit = F.transform("vec", lambda x: x.cast("double") / F.sqrt(norm))
    points = sample.select(array_to_vector(unit).alias("features"))
    fitted = KMeans(k=cells, seed=SEED, maxIter=ROUNDS).fit(points).clusterCenters()
    middle = unit_rows(np.array(fitted))
    centres = spark.sparkContext.broadcast(middle)
    books = spark.sparkContext.broadcast(_books(sample, dim))

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            unit = stacked(frame["vec"], dim)
            near = closest(unit, centres.value, COPIES)
            codes = [c.tobytes() for c in encoded(unit, books.value)]
            yield pd.DataFrame({"id": frame["id"], "cells": list(near), "code": codes})

    placed = rows.mapInPandas(place, "id long, cells array<long>, code binary")
    entries = materialize(placed.select("id", "code", F.explode("cells").alias("cell")), "index-entries")
    blocks = entries.groupBy("cell").agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias("blocks"))
    blocks = materialize(blocks, "index-blocks")  # a row per cell
    block = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block")
    codes = entries.join(F.broadcast(blocks), "cell").select("cell", block, "id", "code")
    codes = materialize(codes, "index-codes", cluster_by=["cell", "block", "id"])
    index = VectorIndex(codes, rows, blocks, centres, books, len(middle), max(REFINED, k), len(middle))
    return measured(index, sample, k, recall)


def measured(index: VectorIndex, sample: DataFrame, k: int, recall: float) -> VectorIndex:
    """``index`` with as few probes and compared rows as find the exact ``k`` hits of ``ASKED`` sampled rows.

    The cells looked into must hold the share ``recall`` of the hits. Then the number of
    compared rows is doubled until a search loses no more than half as much again.
    """
    asked = sample.orderBy(F.md5(F.col("id").cast("string"))).limit(ASKED)
    asked = materialize(asked, "index-asked")
    exact = materialize(top_k(index.vectors, asked, k).select("query_id", "id"), "index-exact")
    cells = index.codes.select("id", "cell").join(exact.select("id").distinct(), "id").groupBy("id").agg(F.collect_list("cell").alias("cells"))
    pairs = exact.join(cells, "id").join(asked.select(F.col("id").alias("query_id"), "vec"), "query_id").collect()  # k per asked row
    order = {r.query_id: np.argsort(closest(unit_rows(np.array([r.vec], float)), index.centres.value, index.cells)[0]) for r in pairs}
    needed = np.sort([min(order[r.query_id][c] for c in r.cells) + 1 for r in pairs])
    if not len(needed):
        return index
    index = index._replace(probes=int(needed[int(np.ceil(recall * len(needed))) - 1]))
    least = (1 - 1.5 * (1 - recall)) * len(needed)
    while True:
        found = search_index(index, asked, k).join(exact, ["query_id", "id"]).count()
        if found >= least or index.refined >= MOST_REFINED:
            return index
        index = index._replace(refined=2 * index.refined)


def search_index(index: VectorIndex, queries: DataFrame, k: int, probes: int | None = None) -> DataFrame:
    """The best ``k`` rows of each query in the cells closest to it: (query_id, id, score, rank).

    ``queries`` has ``id`` and ``vec``. Codes of a cell are scored block by block,
    for at most about ``TOGETHER`` queries at a time; the best by their codes are
    compared by their vectors.
    """
    centres, books, looked, refined = index.centres, index.books, probes or index.probes, index.refined
    dim = index.centres.value.shape[1]

    @F.pandas_udf("array<long>")
    def nearest_cells(vecs: pd.Series) -> pd.Series:
        return pd.Series(list(closest(stacked(vecs, dim), centres.value, looked)), dtype=object)

    asking = queries.select(F.col("id").alias("query_id"), "vec")
    probing = materialize(asking.select("query_id", "vec", F.explode(nearest_cells("vec")).alias("cell")), "index-probing")
    crowds = probing.groupBy("cell").agg(F.ceil(F.count("*") / F.lit(TOGETHER)).cast("int").alias("crowds"))  # a row per cell
    plan = materialize(index.blocks.join(crowds, "cell"), "index-plan")
    crowd = F.pmod(F.xxhash64("query_id"), F.col("crowds")).cast("int").alias("crowd")
    left = index.codes.join(F.broadcast(plan.select("cell", "crowds")), "cell")
    left = left.select("cell", "block", "id", "code", F.explode(F.sequence(F.lit(0), F.col("crowds") - 1)).alias("crowd"))
    right = probing.join(F.broadcast(plan), "cell")
    right = right.select("cell", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "query_id", "vec", crowd)

    def score(codes: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(codes) or not len(asked):
            return pd.DataFrame({"query_id": [], "id": [], "near": []})
        stored = np.frombuffer(b"".join(codes["code"]), np.uint8).reshape(len(codes), -1)
        unit, ids = stacked(asked["vec"], dim), codes["id"].to_numpy()
        near = np.zeros((len(unit), len(ids)), np.float32)
        for k_, (s, book) in enumerate(zip(stretches(dim), books.value)):
            near += (unit[:, s] @ book.T).astype(np.float32)[:, stored[:, k_]]  # a table of distances per query and stretch
        keep = min(refined, len(ids))
        best = np.argpartition(-near, keep - 1, axis=1)[:, :keep]
        query = np.repeat(asked["query_id"].to_numpy(), keep)
        return pd.DataFrame({"query_id": query, "id": ids[best].ravel(), "near": np.take_along_axis(near, best, 1).ravel()})

    keys = ["cell", "block", "crowd"]
    scored = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(score, "query_id long, id long, near float")
    once = scored.groupBy("query_id", "id").agg(F.max("near").alias("near"))  # a row lies in several cells
    order = Window.partitionBy("query_id").orderBy(F.desc("near"), "id")
    few = once.withColumn("n", F.row_number().over(order)).where(F.col("n") <= refined).select("query_id", "id")
    few = materialize(few, "index-few")
    pairs = few.join(index.vectors, "id").join(asking.withColumnRenamed("vec", "asked"), "query_id")

    @F.pandas_udf("double")
    def similar(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(np.round((stacked(a, dim) * stacked(b, dim)).sum(axis=1), SCORE_DIGITS))

    exact = pairs.select("query_id", "id", similar("vec", "asked").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return exact.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def share_read(index: VectorIndex, queries: DataFrame) -> float:
    """The mean share of the table whose codes a query scores."""
    centres, looked, dim = index.centres, index.probes, index.centres.value.shape[1]

    @F.pandas_udf("array<long>")
    def nearest_cells(vecs: pd.Series) -> pd.Series:
        return pd.Series(list(closest(stacked(vecs, dim), centres.value, looked)), dtype=object)

    sizes = index.codes.groupBy("cell").agg(F.count("*").alias("rows"))
    read = queries.select("id", F.explode(nearest_cells("vec")).alias("cell")).join(sizes, "cell")
    total = read.agg(F.sum("rows")).first()[0] or 0
    return total / COPIES / max(1, queries.count()) / max(1, index.vectors.count())
