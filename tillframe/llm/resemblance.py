"""Near duplicates by the Jaccard similarity of their five-word shingles.

Texts that may be similar meet in buckets: ``BANDS`` keys per text, each over
``ROWS`` minima of independent hashes of its shingles. Two texts of similarity s
share a key with probability 1 - (1 - s ** ROWS) ** BANDS, which is above
0.99999 from 0.8 on. Inside a bucket similarities are counted on the whole sets.
Near copies of that similarity differ in up to 11 of 64 SimHash bits, too many
for an index by segments; texts that ``simhash`` links through its segments meet
in one more bucket, and are held against the same similarity there.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillframe.functions.skew import join_keyed
from tillframe.llm import simhash
from tillframe.llm.common import bucket_links, connected, prepare
from tillframe.sources.storage import materialize

WORDS, LEAST = 5, 0.8  # fixed values: words of a shingle, similarity of a link
BANDS, ROWS = 30, 5  # fixed values: keys per text, minima per key
BLOCK = 512  # members of a bucket that meet in one task: they bring their whole sets
SLICE = 1 << 12  # shingles hashed at a time
BROADCAST = 200_000  # texts of shared buckets up to which their keys are broadcast
_draw = np.random.default_rng(simhash.SEED)  # fixed value: the hash functions
FACTORS = _draw.integers(0, 1 << 63, (BANDS * ROWS, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
MASKS = _draw.integers(0, 1 << 63, (BANDS * ROWS, 1), dtype=np.uint64) * np.uint64(2)


def shingles(text: bytes | None, words: int = WORDS) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles; a shorter text is one shingle, one without words none."""
    parts = (text or b"").lower().split()  # bytes: only A-Z change, only ASCII white space separates
    joined = b" ".join(parts)
    ends = list(accumulate(parts, lambda at, w: at + 1 + len(w), initial=-1))  # before each word, after the last
    size = min(words, len(parts)) or 1
    digest = xxhash.xxh64_intdigest
    hashes = [digest(joined[a + 1 : b], simhash.SEED) for a, b in zip(ends, ends[size:])]
    return np.unique(np.array(hashes, dtype="<u8"))


def bands(hashes: np.ndarray) -> list[int]:
    """The bucket keys of a set of shingles, as signed 64-bit numbers."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, "<u8")
    for first in range(0, len(hashes), SLICE):
        np.minimum(least, ((hashes[first : first + SLICE] ^ MASKS) * FACTORS).min(axis=1), out=least)
    keys = [xxhash.xxh64_intdigest(row.tobytes(), k) for k, row in enumerate(least.reshape(BANDS, ROWS))]
    return np.array(keys, "<u8").view("<i8").tolist()


def reached(sets: list[np.ndarray], least: float = LEAST) -> np.ndarray:
    """For each set the first one that it reaches through similarities of ``least`` and more.

    A set is compared with those not reached yet, all at once: a dense group
    costs a pass or two, and every pair that could join two groups is counted.
    """
    n, sizes = len(sets), np.array([len(s) for s in sets])
    ends = np.r_[0, np.cumsum(sizes)]
    values, place = np.unique(np.concatenate(sets), return_inverse=True)
    mark = np.zeros(len(values), bool)
    root, left = np.arange(n), np.ones(n, bool)
    item, owner = place, np.repeat(np.arange(n), sizes)
    for start in range(n):
        if not left[start]:
            continue
        left[start], todo = False, [start]
        while todo:
            at = todo.pop()
            own = place[ends[at] : ends[at + 1]]
            mark[own] = True
            common = np.bincount(owner[mark[item]], minlength=n)
            mark[own] = False
            fresh = np.flatnonzero(left & (common + 1e-9 >= least * (sizes[at] + sizes - common)))
            if len(fresh):
                root[fresh], left[fresh] = start, False
                todo += fresh.tolist()
                stays = left[owner]
                item, owner = item[stays], owner[stays]
    return root


def _linked(frame: pd.DataFrame, member: str, least: float, weight: str | None) -> pd.DataFrame:
    """Links inside the groups of ``frame`` (sorted by group), as one row per linked member."""
    ids, group = frame[member].to_numpy(np.int64), frame["_group"].to_numpy()
    sets = [np.frombuffer(s, "<u8") for s in frame["shingles"]]
    cuts = np.r_[0, np.flatnonzero(np.diff(group)) + 1, len(group)]
    root = np.concatenate([a + reached(sets[a:b], least) for a, b in zip(cuts, cuts[1:])])
    linked = np.flatnonzero(root != np.arange(len(root)))
    return pd.DataFrame({"u": ids[linked], "root": ids[root[linked]], "n": np.ones(len(linked), np.int64)})


def linked_groups(classes: DataFrame) -> DataFrame:
    """(fp, key) for each distinct text of ``classes`` (fp, sim): a key per group that ``simhash`` links."""
    roots = simhash.components(classes.select(F.col("sim").alias("fp")).distinct())
    roots = materialize(roots.select(F.col("fp").alias("sim"), "root"), "resemblance-simhash")
    found = join_keyed(classes.select("fp", "sim"), roots, "sim")
    return found.select("fp", F.xxhash64(F.lit("simhash"), F.coalesce("root", "sim")).alias("key"))


def components(docs: DataFrame, classes: DataFrame, least: float = LEAST, block: int = BLOCK) -> DataFrame:
    """(fp, root) for each distinct text of ``classes`` (fp, bands, sim) that is linked to another."""
    index = classes.select("fp", F.explode("bands").alias("key")).union(linked_groups(classes))
    buckets = index.groupBy("key").agg(F.count("*").alias("count"), F.sum(F.xxhash64("fp").cast("decimal(38,0)")).alias("who"))
    # Near copies share many buckets: of those with the same members one is enough.
    once = buckets.where("count > 1").groupBy("count", "who").agg(F.min("key").alias("key"))
    shared = materialize(once.select("key", "count"), "resemblance-buckets")
    members = materialize(index.join(shared.select("key"), "key"), "resemblance-members")
    wanted = materialize(members.select("fp").distinct(), "resemblance-texts")
    near = F.broadcast(wanted) if wanted.count() < BROADCAST else wanted

    @F.pandas_udf("binary")
    def packed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([shingles(t).tobytes() for t in texts], dtype=object)

    texts = docs.select(key_of().alias("fp"), "text").join(near, "fp").groupBy("fp").agg(F.first("text").alias("text"))
    sets = materialize(texts.select("fp", packed(F.col("text").cast("binary")).alias("shingles")), "resemblance-sets")
    hot = shared.where(F.col("count") > block)
    found = bucket_links(members.join(sets, "fp"), "fp", least, "resemblance", hot=hot, block=block, compare=_linked)
    roots = connected(found.select("u", F.col("root").alias("v")), "resemblance")
    return roots.select(F.col("node").alias("fp"), "root")


def key_of():
    """Equal texts are one member of the index."""
    return F.xxhash64(F.coalesce("text", F.lit("")))


def grouped(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, digest, component_id) for each row of ``docs`` (doc_id, text), as ``simhash.grouped``."""
    prepare(docs.sparkSession)
    docs = docs.select("doc_id", "text")

    @F.pandas_udf("array<long>")
    def keys(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([bands(shingles(t)) for t in texts], dtype=object)

    own = [key_of().alias("fp"), simhash.digest().alias("digest"), simhash.fingerprint_of("text").alias("sim")]
    rows = docs.select("doc_id", *own, keys(F.col("text").cast("binary")).alias("bands"))
    found = materialize(rows, "resemblance-keys")
    first = found.groupBy("fp").agg(F.min("doc_id").alias("first"), F.first("bands").alias("bands"), F.first("sim").alias("sim"))
    classes = materialize(first, "resemblance-classes")
    roots = materialize(components(docs, classes.select("fp", "bands", "sim")), "resemblance-roots")
    return simhash.named(found.drop("bands", "sim"), classes.drop("bands", "sim"), roots)


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` (all columns) that stay: one per group, as ``simhash.keep_one`` picks it."""
    return simhash.one_per_group(docs, grouped(docs))
