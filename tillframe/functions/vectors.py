"""Exact cosine search: blocks of both sides are multiplied in the tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillframe.functions.ordering import with_scalars
from tillframe.sources.storage import materialize

BLOCK_ROWS = 4096  # vectors of a block; two blocks meet in a task
SCORE_DIGITS = 6
MATRIX_CELLS = 4_000_000  # scores held at once in a task


def unit_rows(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to length one; zero rows stay zero."""
    norms = np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))
    return np.divide(vectors, norms, out=np.zeros_like(vectors), where=norms > 0)


def stack(column: pd.Series) -> np.ndarray:
    return np.vstack(column.to_numpy()).astype(np.float64) if len(column) else np.zeros((0, 1))


def first_k(hits: pd.DataFrame, k: int) -> pd.DataFrame:
    """The best ``k`` hits of each query, lowest id on ties."""
    ordered = hits.sort_values(["query_id", "score", "id"], ascending=[True, False, True])
    return ordered.groupby("query_id", sort=False).head(k)


def packed(df: DataFrame, block_rows: int) -> DataFrame:
    """(block, ids, vecs): rows (id, vec) in blocks of about ``block_rows``, by a hash of the id."""
    total = df.count()
    count = max(1, -(-total // block_rows))
    block = F.pmod(F.xxhash64("id"), F.lit(count)).cast("int")
    rows = df.select(block.alias("block"), F.struct("id", "vec").alias("r"))
    lists = rows.groupBy("block").agg(F.collect_list("r").alias("r"))
    return lists.select("block", F.col("r.id").alias("ids"), F.col("r.vec").alias("vecs"))


def paired_blocks(rows: DataFrame, others: DataFrame, block_rows: int) -> DataFrame:
    """Every block of ``rows`` next to every block of ``others``: (ids, vecs, other_ids, other_vecs).

    A row here is a pair of blocks, one task's piece of work: the number of rows
    is that of the blocks, and neither side passes through the driver.
    """
    left = materialize(packed(rows, block_rows), "vector-blocks")
    right = materialize(packed(others, block_rows), "vector-blocks")
    numbers = right.agg(F.collect_list("block").alias("numbers"))  # one row of block numbers
    spread = with_scalars(left, numbers).select("ids", "vecs", F.explode("numbers").alias("block"))
    right = right.select("block", F.col("ids").alias("other_ids"), F.col("vecs").alias("other_vecs"))
    joined = spread.join(right, "block")
    return joined.repartition(F.xxhash64("block", F.element_at("ids", 1)))


def _matrix(vecs) -> np.ndarray:
    return unit_rows(np.vstack([np.asarray(v, np.float64) for v in vecs]))


def nearest(rows: DataFrame, targets: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """For each row the most similar target: (id, target_id, score), lowest target id on ties.

    Both inputs have ``id`` and ``vec``. Blocks of both sides are multiplied in
    the tasks, which hand on one winner per row; winners of different blocks
    are merged by a plain maximum. Without targets, both are null.
    """

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for ids, vecs, other_ids, other_vecs in batch.itertuples(index=False):
                order = np.argsort(other_ids, kind="stable")
                targets, matrix = np.asarray(other_ids)[order], _matrix(other_vecs)[order]
                mine = _matrix(vecs)
                step = max(1, MATRIX_CELLS // len(targets))
                for start in range(0, len(mine), step):
                    scores = np.round(mine[start : start + step] @ matrix.T, SCORE_DIGITS)
                    top = scores.argmax(axis=1)  # the first of equals: the lowest id
                    won = scores[np.arange(len(top)), top]
                    yield pd.DataFrame({"id": ids[start : start + step], "target_id": targets[top], "score": won})

    pairs = paired_blocks(rows.select("id", "vec"), targets.select("id", "vec"), block_rows)
    found = pairs.select("ids", "vecs", "other_ids", "other_vecs").mapInPandas(best, "id long, target_id long, score double")
    winner = F.max(F.struct("score", (-F.col("target_id")).alias("_neg"))).alias("w")
    merged = found.groupBy("id").agg(winner)
    merged = merged.select("id", (-F.col("w._neg")).alias("target_id"), F.col("w.score").alias("score"))
    return rows.select("id").join(merged, "id", "left")


def top_k(corpus: DataFrame, queries: DataFrame, k: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The ``k`` most similar corpus rows of each query: (query_id, id, score, rank).

    Of each pair of blocks the best ``k`` per query are handed on, so what is
    shuffled is ``k`` rows per query and block of the corpus.
    """

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for ids, vecs, query_ids, query_vecs in batch.itertuples(index=False):
                row_ids, units = np.asarray(ids), _matrix(vecs).T
                queries, matrix = np.asarray(query_ids), _matrix(query_vecs)
                step = max(1, MATRIX_CELLS // len(row_ids))
                for start in range(0, len(queries), step):
                    scores = np.round(matrix[start : start + step] @ units, SCORE_DIGITS)
                    # All rows at or above the k-th score: ties are cut by id below.
                    place = max(scores.shape[1] - k, 0)
                    limit = np.partition(scores, place, axis=1)[:, place : place + 1]
                    q, r = np.nonzero(scores >= limit)
                    hits = pd.DataFrame({"query_id": queries[start + q], "id": row_ids[r], "score": scores[q, r]})
                    yield first_k(hits, k)

    pairs = paired_blocks(corpus.select("id", "vec"), queries.select("id", "vec"), block_rows)
    found = pairs.select("ids", "vecs", "other_ids", "other_vecs").mapInPandas(best, "query_id long, id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    ranked = found.withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= k)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
