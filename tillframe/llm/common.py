"""What the operators share: settings, links inside buckets of equal keys, and connected components."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tillframe.functions.skew import join_keyed
from tillframe.sources.storage import materialize

WORD = r"[^\x20\x09-\x0D]+"  # fixed value: what counts as a word where sizes are words
BLOCK = 2048  # members of a bucket that meet in one task; larger buckets meet block by block


def prepare(spark: SparkSession) -> SparkSession:
    """Texts are wide: hand them to Python in small batches; split skewed join partitions."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
    # Rows that lie together by some of the keys of a join are not shuffled again for all of them.
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    return spark


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def least_labels(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the links ``u[i] - v[i]`` and, for each, the smallest node it reaches through them."""
    nodes, place = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = place[: len(u)], place[len(u) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if np.array_equal(new, label):
            return nodes, nodes[label]
        label = new


def _links(frame: pd.DataFrame, member: str, verify: Callable, weight: str | None) -> pd.DataFrame:
    """Links inside the groups of ``frame`` (sorted by group), as one row per linked member."""
    ids = frame[member].to_numpy(np.int64)
    heavy = frame[weight].to_numpy(np.int64) if weight else np.ones(len(frame), np.int64)
    group = frame["_group"].to_numpy()
    side, own = frame["_side"].to_numpy(), frame["_own"].to_numpy()
    check = verify(frame)
    left, right = [], []
    for shift in range(1, len(frame)):
        same = group[shift:] == group[:-shift]
        if not same.any():
            break
        # A pair of blocks compares across only; a block with itself compares all.
        at = np.flatnonzero(same & (~side[:-shift] | (own[shift:] != own[:-shift])))
        if len(at):
            at = at[check(at, at + shift)]
            left.append(at)
            right.append(at + shift)
    i = np.concatenate(left) if left else np.zeros(0, np.int64)
    j = np.concatenate(right) if right else np.zeros(0, np.int64)
    nodes, root = least_labels(ids[i], ids[j])
    count = np.zeros(len(nodes), np.int64)
    np.add.at(count, np.searchsorted(nodes, ids[i]), heavy[j])
    np.add.at(count, np.searchsorted(nodes, ids[j]), heavy[i])
    return pd.DataFrame({"u": nodes, "root": root, "n": count})


def bucket_links(
    index: DataFrame,
    member: str,
    verify: Callable,
    name: str,
    weight: str | None = None,
    hot: DataFrame | None = None,
    block: int = BLOCK,
    compare: Callable = _links,
) -> DataFrame:
    """Compare the members of each bucket and return (u, root, n).

    ``index`` has a long ``key``, a long ``member`` and whatever ``verify`` needs;
    a member is in a bucket once. ``verify(frame)`` returns a function of two
    row-number arrays that says which pairs are linked. Per call of a task, each
    linked member comes back with its number of links (or the sum of the
    column ``weight`` over the members linked to it) and the smallest member
    that it reaches, so a dense bucket costs as many rows as it has members, not
    pairs.

    ``hot`` (key, count) must list every bucket of more than ``block`` members; by
    default the buckets are counted. These are cut into blocks by a hash of the
    member, and each pair of blocks is compared by one task: nothing is dropped.
    The index is shuffled once; buckets of one member end there. ``compare``
    takes the place of comparing pair by pair.
    """
    if hot is None:
        hot = materialize(index.groupBy("key").count().where(F.col("count") > block), f"{name}-buckets")
    blocks = F.coalesce(F.ceil(F.col("count") / F.lit(block)), F.lit(1)).cast("int")
    own = F.pmod(F.xxhash64(F.col(member), F.lit(7)), blocks).cast("int")
    rows = index.join(hot, "key", "left").withColumn("_own", own)
    rows = rows.withColumn("_other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    group = F.xxhash64("key", F.least("_own", "_other"), F.greatest("_own", "_other"))
    # ``_side``: a pair of two different blocks. Then own and other are the two blocks, and neither is both.
    rows = rows.withColumn("_group", group).withColumn("_side", F.col("_own") != F.col("_other"))
    rows = rows.drop("count", "_other", "key")
    # Counting over the group puts its rows next to each other, at most two blocks of them.
    rows = rows.withColumn("_n", F.count("*").over(Window.partitionBy("_group"))).where("_n > 1").drop("_n")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest: list[pd.DataFrame] = []
        for frame in frames:
            if not len(frame):
                continue
            group = frame["_group"].to_numpy()
            last = int(np.searchsorted(group, group[-1]))  # the last group may go on in the next batch
            if last:
                done = pd.concat([*rest, frame.iloc[:last]], ignore_index=True) if rest else frame.iloc[:last]
                yield compare(done, member, verify, weight)
                rest = [frame.iloc[last:]]
            elif rest and rest[0]["_group"].iloc[0] != group[0]:
                done = pd.concat(rest, ignore_index=True)
                yield compare(done, member, verify, weight)
                rest = [frame]
            else:
                rest.append(frame)
        if rest:
            done = pd.concat(rest, ignore_index=True)
            yield compare(done, member, verify, weight)

    return rows.mapInPandas(run, "u long, root long, n long")


def connected(links: DataFrame, name: str) -> DataFrame:
    """(node, root): for every node of ``links`` (u, v) the smallest node it reaches.

    Large-star and small-star steps in turn: each hangs the neighbours of a node
    onto the smallest of them, until only stars are left. Every step is written
    to the shared folder, so a lost executor costs a re-read, and two numbers
    decide about the end.
    """
    edges = materialize(
        links.select(F.greatest("u", "v").alias("a"), F.least("u", "v").alias("b")).where("a > b").distinct(),
        f"{name}-links",
    )
    seen = None
    while True:
        mark = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if mark == seen or mark[0] == 0:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
                edges.select("b", "b").distinct()
            )
        seen = mark
        both = edges.union(edges.select("b", "a"))
        # The smallest member of a large group is a neighbour of all others: its rows are spread by ``join_keyed``.
        low = materialize(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), f"{name}-least")
        large = join_keyed(both.where("b > a"), low, "a", "inner").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = materialize(large.distinct(), f"{name}-large")
        low = materialize(large.groupBy("a").agg(F.min("b").alias("m")), f"{name}-least")
        small = join_keyed(large, low, "a", "inner").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = materialize(small.union(low.select("a", "m")).distinct(), f"{name}-links")


def chosen(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Only the columns an operator uses: whatever else the table has cannot clash with its own names."""
    return df.select(*[F.col(c) for c in columns])
