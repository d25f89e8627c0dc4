"""Near duplicates by SimHash fingerprints, found through one-wildcard variants of their segments.

A fingerprint of 64 bits is cut into ``max_bits // 2 + 1`` segments, so that of
two fingerprints that differ in at most ``max_bits`` bits some segment differs in
at most one. Each segment is indexed once per bit, with this bit wiped: two
segments at one bit's distance are equal in the variant that wipes it, equal
segments in all of them. Variants meet by an equality join and are verified.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillframe.llm.common import BLOCK, bucket_links, connected, prepare
from tillframe.sources.storage import materialize

BITS = 64
SEED = 42  # fixed value: seed of XXH64
SLICE = 1 << 16  # shingles hashed at a time


def text_fingerprint(text: bytes | None, words: int = 3) -> int:
    """Fingerprint of UTF-8 bytes as a signed 64-bit number; null and texts without words give 0."""
    parts = (text or b"").lower().split()  # bytes: only A-Z change, only ASCII white space separates
    if not parts:
        return 0
    joined = b" ".join(parts)
    ends = list(accumulate(parts, lambda at, w: at + 1 + len(w), initial=-1))  # before each word, after the last
    count = max(1, len(parts) - words + 1)
    size = min(words, len(parts))
    ones = np.zeros(BITS, np.int64)
    digest = xxhash.xxh64_intdigest
    for first in range(0, count, SLICE):
        last = min(count, first + SLICE)
        hashes = np.array(
            [digest(joined[a + 1 : b], SEED) for a, b in zip(ends[first:last], ends[first + size : last + size])],
            dtype="<u8",
        )
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > count, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, fp, digest) for each row of ``docs`` (doc_id, text); ``digest`` tells texts without an id apart."""

    return docs.select("doc_id", fingerprint_of("text", words).alias("fp"), digest().alias("digest"))


def fingerprint_of(column: str, words: int = 3):
    """The fingerprint of a column of texts."""

    @F.pandas_udf("long")
    def fingerprint(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([text_fingerprint(t, words) for t in texts], dtype="int64")

    return fingerprint(F.col(column).cast("binary"))


def digest():
    return F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.lit(0))


def segments(max_bits: int) -> list[tuple[int, int]]:
    """(first bit, width) of the segments."""
    n = max_bits // 2 + 1
    cuts = [BITS * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _variant(value, bit: int, whole: int):
    """Key of the segment ``whole`` (a mask) of ``value`` with ``bit`` wiped."""
    return F.xxhash64(F.lit(bit), value.bitwiseAND(F.lit(_signed(whole & ~(1 << bit)))))


def _masks(max_bits: int) -> list[tuple[int, int, int]]:
    """(mask, first bit, bit after the last) of the segments."""
    return [(((1 << width) - 1) << first, first, first + width) for first, width in segments(max_bits)]


def variants(max_bits: int):
    """The keys of a fingerprint: every segment with every single bit wiped."""
    return F.array(*[_variant(F.col("fp"), bit, m) for m, a, b in _masks(max_bits) for bit in range(a, b)])


def hot_buckets(classes: DataFrame, max_bits: int, block: int) -> DataFrame:
    """(key, count): all buckets that may hold more than ``block`` members, with an upper bound of their members.

    A bucket holds two values of a segment, with and without its bit. It can be
    that large only if one of the two has more than half of that many members;
    counting segments takes a row per segment, not one per variant.
    """
    cut = [F.struct(F.lit(k).alias("part"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("value"))
           for k, (m, _, _) in enumerate(_masks(max_bits))]
    values = classes.select(F.explode(F.array(*cut)).alias("s")).groupBy("s.part", "s.value").count()
    large = materialize(values.where(F.col("count") > block // 2), "simhash-hot")
    keys = F.lit(None).cast("array<long>")
    for k, (m, a, b) in enumerate(_masks(max_bits)):
        keys = F.when(F.col("part") == k, F.array(*[_variant(F.col("value"), bit, m) for bit in range(a, b)])).otherwise(keys)
    each = large.select(F.explode(keys).alias("key"), F.col("count") + block // 2)
    return materialize(each.toDF("key", "count").groupBy("key").agg(F.sum("count").alias("count")), "simhash-buckets")


def components(classes: DataFrame, max_bits: int = 3, block: int = BLOCK) -> DataFrame:
    """(fp, root) for each distinct fingerprint of ``classes`` (fp) that is linked to another."""
    index = classes.select("fp", F.explode(variants(max_bits)).alias("key"))

    def verify(frame: pd.DataFrame):
        fp = frame["fp"].to_numpy(np.int64)
        return lambda i, j: np.bitwise_count((fp[i] ^ fp[j]).view(np.uint64)) <= max_bits

    found = bucket_links(index, "fp", verify, "simhash", hot=hot_buckets(classes, max_bits, block), block=block)
    roots = connected(found.select("u", F.col("root").alias("v")), "simhash")
    return roots.select(F.col("node").alias("fp"), "root")


def near_duplicates(docs: DataFrame, words: int = 3, max_bits: int = 3) -> DataFrame:
    """Group documents whose fingerprints are linked directly or through others.

    Returns (doc_id, fp, component_id), one row per row of ``docs`` (doc_id,
    text); ``component_id`` is the smallest doc_id of the group. Null and empty
    texts have fingerprint 0 and link like any other. A row without doc_id gets
    the smallest doc_id of its group, null if the group has none. Rows that
    repeat a doc_id stay separate rows. An empty table gives no rows. Copies are
    one fingerprint in the index, so a hot text costs one entry.
    """
    return grouped(docs, words, max_bits).select("doc_id", "fp", "component_id")


def grouped(docs: DataFrame, words: int, max_bits: int) -> DataFrame:
    """``near_duplicates`` with the digest of ``fingerprints``."""
    prepare(docs.sparkSession)
    found = materialize(fingerprints(docs.select("doc_id", "text"), words), "fingerprints")
    classes = materialize(found.groupBy("fp").agg(F.min("doc_id").alias("first")), "fingerprint-classes")
    return named(found, classes, materialize(components(classes.select("fp"), max_bits), "fingerprint-roots"))


def named(found: DataFrame, classes: DataFrame, roots: DataFrame) -> DataFrame:
    """(doc_id, fp, digest, component_id): rows of ``found`` with the smallest id of their group."""
    joined = classes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    smallest = joined.groupBy("root").agg(F.min("first").alias("component_id"))
    groups = materialize(joined.join(smallest, "root").select("fp", "component_id"), "fingerprint-groups")
    return found.join(groups, "fp").select("doc_id", "fp", "digest", "component_id")


def keep_one(docs: DataFrame, words: int = 3, max_bits: int = 3) -> DataFrame:
    """The rows of ``docs`` (all columns) that stay: one per group of near duplicates.

    The document with the smallest doc_id stays, once also if its row repeats.
    Rows without doc_id stay only if no document of their group has one, and
    then once per text.
    """
    return one_per_group(docs, grouped(docs, words, max_bits))


def one_per_group(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """``keep_one`` for any groups (doc_id, digest, component_id) of the rows of ``docs``."""
    groups = groups.where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    stays = groups.select(F.col("doc_id").alias("__llm_keep"), F.col("digest").alias("__llm_text")).distinct()
    stays = materialize(stays, "simhash-kept")
    same = F.col("doc_id").eqNullSafe(F.col("__llm_keep")) & (digest() == F.col("__llm_text"))
    once = Window.partitionBy("__llm_keep", "__llm_text").orderBy("__llm_text")
    # One shuffle of the texts at every size, for the join and the window alike.
    joined = docs.join(stays.hint("merge"), same).withColumn("__llm_nth", F.row_number().over(once))
    return joined.where("__llm_nth = 1").drop("__llm_keep", "__llm_text", "__llm_nth")
