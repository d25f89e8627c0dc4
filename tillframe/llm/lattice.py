"""Near duplicates of embeddings by lattice hashing.

A vector of length one is projected onto 8 random directions; the nearest point
of the E8 lattice is its cell in a table. Further tables use other directions. A
vector is also entered in the neighbouring cells that are nearest to it, so that
two close vectors on both sides of a wall meet. Vectors that share a cell are
compared by cosine in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillframe.llm.common import BLOCK, bucket_links, connected, prepare
from tillframe.sources.storage import materialize

COSINE = 0.93
TABLES, PROBES = 6, 3
WIDTH = 1.0  # of a lattice unit, in lengths of a projected difference; larger cells find more and compare more
SEED = 20240501
PAIRS = 20_000  # pairs whose cells are compared at a time

# The 240 shortest vectors of E8: from a cell to its neighbours.
NEIGHBOURS = np.array(
    [
        [s if k == i else t if k == j else 0.0 for k in range(8)]
        for i, j in combinations(range(8), 2)
        for s, t in product((1.0, -1.0), repeat=2)
    ]
    + [list(v) for v in product((0.5, -0.5), repeat=8) if sum(x < 0 for x in v) % 2 == 0]
)


def _nearest_d8(x: np.ndarray) -> np.ndarray:
    """Nearest points with integer coordinates of even sum."""
    point = np.round(x)
    odd = np.flatnonzero(point.sum(1) % 2 != 0)
    if len(odd):  # round the worst coordinate the other way
        gap = x[odd] - point[odd]
        worst = np.argmax(np.abs(gap), axis=1)
        point[odd, worst] += np.where(gap[np.arange(len(odd)), worst] >= 0, 1.0, -1.0)
    return point


def nearest_e8(x: np.ndarray) -> np.ndarray:
    """The nearest E8 point of each row: in D8, or in D8 moved by one half."""
    whole, half = _nearest_d8(x), _nearest_d8(x - 0.5) + 0.5
    closer = ((x - half) ** 2).sum(1) < ((x - whole) ** 2).sum(1)
    return np.where(closer[:, None], half, whole)


def directions(dim: int, table: int) -> np.ndarray:
    return np.random.default_rng([SEED, dim, table]).standard_normal((dim, 8))


def cells(vectors: np.ndarray, tables: int = TABLES, probes: int = PROBES, width: float = WIDTH) -> np.ndarray:
    """The cells (64-bit numbers) of each row in all tables: its own and ``probes`` neighbours."""
    n, dim = vectors.shape
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    keys = []
    for table in range(tables):
        mix = np.random.default_rng([SEED, table]).integers(1, 1 << 62, 8) * 2 + 1
        x = unit @ directions(dim, table) / width
        home = nearest_e8(x)
        near = (x - home) @ NEIGHBOURS.T
        best = np.argsort(-near, axis=1, kind="stable")[:, :probes]
        points = np.concatenate([home[:, None, :], home[:, None, :] + NEIGHBOURS[best]], axis=1)
        doubled = np.round(2 * points).astype(np.int64)
        with np.errstate(over="ignore"):
            keys.append((doubled * mix).sum(2) * np.int64(2654435761) + table)
    return np.sort(np.concatenate(keys, axis=1), axis=1) if tables else np.zeros((n, 0), np.int64)


def _rows(column: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """Vectors as rows, filled up with zeros to one length, and their lengths."""
    dims = np.array([len(v) for v in column])
    rows = np.zeros((len(dims), max(dims, default=0)))
    for dim in np.unique(dims):
        at = np.flatnonzero(dims == dim)
        rows[at, :dim] = np.vstack([column.iloc[i] for i in at]).astype(np.float64)
    return rows, dims


def near_vectors(
    vectors: DataFrame, threshold: float = COSINE, tables: int = TABLES, probes: int = PROBES, width: float = WIDTH, block: int = BLOCK
) -> DataFrame:
    """Links between vectors of equal label: (vec_id, n_links, component_id, kept) per row.

    ``vectors`` has vec_id, embedding (array of numbers) and label. Vectors that
    are null, empty, zero or hold null or non-finite components, and vectors
    with a null label, link with nothing: no links, their own component, kept.
    Vectors of different lengths never link. Equal vectors of a label are one
    entry of the index that counts as many links as it has copies; a repeated
    row is a copy like any other. A null vec_id is counted by others but is never
    the smallest id; alone, its component is null and it is kept. An empty table
    gives no rows.
    """
    prepare(vectors.sparkSession)
    vec = F.col("embedding")
    sound = F.col("label").isNotNull() & (F.size(vec) > 0) & F.forall(
        vec, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != float("inf"))
    ) & F.exists(vec, lambda x: x != 0)
    # Two 64-bit hashes stand for the vector where rows are matched to their class.
    rows = vectors.select("vec_id", "label", "embedding", F.coalesce(sound, F.lit(False)).alias("sound"))
    rows = rows.withColumn("h1", F.xxhash64("embedding")).withColumn("h2", F.xxhash64(F.lit(1), "embedding"))
    key = ["label", "h1", "h2"]
    classes = rows.where("sound").groupBy(*key).agg(
        F.min("vec_id").alias("first"), F.count("*").alias("copies"), F.any_value("embedding").alias("embedding")
    )
    classes = classes.withColumn("id", F.xxhash64(*key))
    classes = materialize(classes, "vector-classes")

    @F.pandas_udf("array<long>")
    def hashed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for column in batches:
            rows, dims = _rows(column)
            out = np.empty(len(column), object)
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                for i, keys in zip(at, cells(rows[at, :dim], tables, probes, width)):
                    out[i] = keys
            yield pd.Series(out)

    entries = classes.select("id", "copies", "label", "embedding", hashed("embedding").alias("cells"))
    # Only ids travel to the buckets. Vectors are fetched for the members of buckets that have several, with all their
    # cells, so that a pair is reported in one of its common cells only.
    entries = materialize(entries, "vector-cells")
    key_of = F.xxhash64("label", F.size("embedding"), "cell").alias("key")
    narrow = entries.withColumn("cell", F.explode(F.array_distinct("cells"))).select(key_of, "id", "cell")
    shared = materialize(narrow.groupBy("key").count().where("count > 1"), "vector-buckets")
    members = materialize(narrow.join(shared.select("key"), "key"), "vector-members")
    index = members.join(entries.select("id", "copies", "embedding", "cells"), "id")

    def verify(frame: pd.DataFrame):
        full, dims = _rows(frame["embedding"])
        unit = full / np.linalg.norm(full, axis=1, keepdims=True) if len(full) else full
        own = frame["cell"].to_numpy(np.int64)
        every = np.vstack(frame["cells"].to_numpy()) if len(frame) else np.zeros((0, 0), np.int64)

        def check(i: np.ndarray, j: np.ndarray) -> np.ndarray:
            linked = (np.einsum("nd,nd->n", unit[i], unit[j]) >= threshold) & (dims[i] == dims[j])
            at = np.flatnonzero(linked)
            for start in range(0, len(at), PAIRS):
                part = at[start : start + PAIRS]
                a, b = every[i[part]], every[j[part]]
                earlier = (a[:, :, None] == b[:, None, :]).any(2) & (a < own[i[part], None])
                linked[part[earlier.any(1)]] = False
            return linked

        return check

    found = materialize(bucket_links(index, "id", verify, "vectors", weight="copies", hot=shared.where(F.col("count") > block), block=block), "vector-links")
    roots = connected(found.select("u", F.col("root").alias("v")), "vectors").withColumnRenamed("node", "id")
    direct = found.groupBy(F.col("u").alias("id")).agg(F.sum("n").alias("n"))
    joined = classes.drop("embedding").join(roots, "id", "left").join(direct, "id", "left")
    joined = materialize(joined.withColumn("root", F.coalesce("root", "id")), "vector-roots")
    smallest = joined.groupBy("root").agg(F.min("first").alias("component"))
    links = F.coalesce("n", F.lit(0)) + F.col("copies") - 1
    named = joined.join(smallest, "root").select(*[F.col(c).alias(f"_{c}") for c in key], links.alias("links"), "component")
    # Rows without a sound vector match no class; their hashes are left out of the join.
    named = materialize(named, "vector-groups")
    usable = [F.when(F.col("sound"), F.col(c)) == F.col(f"_{c}") for c in key]
    out = rows.drop("embedding").join(named, usable, "left")
    component = F.when(F.col("links").isNotNull(), F.col("component")).otherwise(F.col("vec_id")).cast("long")
    return out.select(
        "vec_id",
        F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.col("vec_id").eqNullSafe(component).alias("kept"),
    )
