"""SimHash groups against a comparison of all pairs."""

from __future__ import annotations

import random
import re

import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tillframe.llm import common, simhash


def plain_fingerprint(text: str | None) -> int:
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    parts = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows, bits=3):
    prints = [(i, plain_fingerprint(t)) for i, t in rows]
    label = {k: k for k in range(len(prints))}

    def find(k):
        while label[k] != k:
            k = label[k]
        return k

    for a in range(len(prints)):
        for b in range(a):
            if bin(prints[a][1] ^ prints[b][1]).count("1") <= bits:
                label[find(a)] = find(b)
    smallest = {}
    for k, (i, _) in enumerate(prints):
        if i is not None:
            smallest[find(k)] = min(smallest.get(find(k), i), i)
    return sorted(((i, p, smallest.get(find(k))) for k, (i, p) in enumerate(prints)), key=repr)


def groups(df):
    return sorted(((r.doc_id, r.fp & (1 << 64) - 1, r.component_id) for r in df.collect()), key=repr)


@given(st.text(alphabet="abAB É1\t\n", max_size=60))
@settings(max_examples=100, deadline=None)
def test_fingerprint_by_definition(text):
    assert simhash.text_fingerprint(text.encode()) & (1 << 64) - 1 == plain_fingerprint(text)


def test_spark_hash_is_the_one_used(spark):
    got = spark.sql("SELECT xxhash64('a b c')").first()[0]
    assert got & (1 << 64) - 1 == xxhash.xxh64_intdigest(b"a b c", 42)


def near_copies(n, seed):
    rng = random.Random(seed)
    rows, words = [], [f"w{k}" for k in range(400)]
    for f in range(n):
        base = [rng.choice(words) for _ in range(rng.randrange(40, 200))]
        for _ in range(rng.randrange(1, 9)):
            copy = list(base)
            for _ in range(rng.randrange(0, 4)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append((len(rows) * 3 + 1, " ".join(copy)))
    return rows


def test_groups_equal_all_pairs(docs):
    rows = near_copies(40, 1)
    rows += [(900, None), (901, ""), (902, " \t\n"), (903, "one"), (904, "ONE"), (905, "one two")]
    rows += [(rows[0][0], rows[0][1]), (None, rows[0][1]), (None, "alone without an id at all")]
    assert groups(simhash.near_duplicates(docs(rows, clashing=True))) == brute_components(rows)


def test_other_widths(docs):
    rows = near_copies(25, 2)
    for bits in (0, 1, 5, 8):
        got = groups(simhash.near_duplicates(docs(rows), max_bits=bits))
        assert got == brute_components(rows, bits), bits


def test_hot_segments_change_nothing(docs):
    rows = near_copies(30, 4)
    fps = simhash.fingerprints(docs(rows)).select("fp").distinct()
    plain = {(r.fp, r.root) for r in simhash.components(fps).collect()}
    assert {(r.fp, r.root) for r in simhash.components(fps, block=4).collect()} == plain and plain


def test_large_buckets_are_compared_block_by_block(spark):
    # All share the upper half and differ little in the lower: one bucket of 700 members.
    fps = sorted({(123 << 32) | random.Random(k).randrange(1 << 11) for k in range(900)})
    index = spark.createDataFrame([(f,) for f in fps], "fp long").withColumn("key", F.lit(5).cast("long"))

    def verify(frame):
        import numpy as np

        fp = frame["fp"].to_numpy()
        return lambda i, j: np.bitwise_count(fp[i] ^ fp[j]) <= 1

    want = {f: sum(bin(f ^ g).count("1") == 1 for g in fps) for f in fps}
    for block in (2048, 50):
        rows = common.bucket_links(index, "fp", verify, "t", block=block).groupBy("u").agg(F.sum("n").alias("n")).collect()
        assert {r.u: r.n for r in rows} == {f: n for f, n in want.items() if n}


@pytest.mark.parametrize("seed", range(3))
def test_connected_equals_union_find(spark, seed):
    rng = random.Random(seed)
    links = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(k, k + 1) for k in range(100, 130)]
    label = {k: k for pair in links for k in pair}

    def find(k):
        while label[k] != k:
            k = label[k]
        return k

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        label[y] = x
    got = common.connected(spark.createDataFrame(links, "u long, v long"), "t").collect()
    linked = {k for a, b in links if a != b for k in (a, b)}
    assert sorted((r.node, r.root) for r in got) == sorted((k, find(k)) for k in linked)


def test_one_of_each_group_stays(docs):
    rows = near_copies(15, 3)
    rows += [(rows[2][0], rows[2][1]), (800, None), (801, None), (None, rows[5][1]), (None, "x y z"), (None, "x y z")]
    kept = simhash.keep_one(docs(rows, clashing=True))
    assert set(kept.columns) > {"doc_id", "text", "fp"}
    stays = sorted({c for _, _, c in brute_components(rows) if c is not None})
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted([*stays, None], key=repr)


def test_empty_table(docs):
    empty = docs([(1, "a")]).where("doc_id < 0")
    assert simhash.near_duplicates(empty).count() == 0 and simhash.keep_one(empty).count() == 0


def test_very_long_text(docs):
    long = " ".join(f"w{k % 977}" for k in range(200_000))
    rows = [(1, long), (2, long + " end"), (3, "short text here")]
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs(rows)).collect()}
    assert got == {1: 1, 2: 1, 3: 3}
