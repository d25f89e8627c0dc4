"""Groups of near copies against the five-word Jaccard similarity of all pairs."""

from __future__ import annotations

import os
import random
from collections import defaultdict

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from tillframe.llm import resemblance

FOLDER = "/root/testdata/sf0.1"


def plain(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[a : a + 5]) for a in range(max(1, len(words) - 4))} if words else set()


def brute(rows):
    """doc_id -> smallest doc_id of its group, from the similarities of all pairs that share a shingle."""
    sets = {i: plain(t) for i, t in rows}
    first = {}
    same = {i: first.setdefault(frozenset(s), i) for i, s in sets.items()}
    lists = defaultdict(list)
    for i in first.values():
        for s in sets[i]:
            lists[s].append(i)
    root = {i: i for i in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in first.values():
        common = defaultdict(int)
        for s in sets[i]:
            for j in lists[s]:
                common[j] += 1
        for j, c in common.items():
            if 5 * c >= 4 * (len(sets[i]) + len(sets[j]) - c):
                a, b = top(i), top(j)
                root[max(a, b)] = min(a, b)
    least = {}
    for i in sorted(sets):
        least.setdefault(top(same[i]), i)
    return {i: least[top(same[i])] for i in sets}


def copies(seed=3, count=60):
    rng = random.Random(seed)
    rows = []
    for k in range(count):
        words = [f"w{rng.randrange(4000)}" for _ in range(rng.randrange(1, 160))]
        for _ in range(4):
            rows.append(" ".join(words))
            words = list(words)
            for _ in range(rng.randrange(0, 3)):
                words[rng.randrange(len(words))] = f"x{rng.randrange(9999)}"
    rows += ["", None, "  ", "One two", "one  TWO", "one two three"]
    return list(enumerate(rows))


@pytest.mark.parametrize("block", [512, 2])
def test_groups_equal_all_pairs(spark, docs, monkeypatch, block):
    monkeypatch.setattr(resemblance.components, "__defaults__", (resemblance.LEAST, block))
    rows = copies()
    want = brute(rows)
    got = {r.doc_id: r.component_id for r in resemblance.grouped(docs(rows, clashing=True)).collect()}
    assert got == want and len(set(want.values())) < len(rows) - 60


def test_stage_keeps_one_of_each_group(spark, docs):
    rows = copies(seed=8, count=30)
    want = set(brute(rows).values())
    df = docs(rows + [rows[0]], clashing=True)
    kept = corpus_pipeline.drop_near_duplicates(spark, df, "")
    assert sorted(r.doc_id for r in kept.collect()) == sorted(want) and kept.columns == df.columns


def test_rows_without_id_and_empty_tables(spark, docs):
    text = " ".join(f"w{k}" for k in range(60))
    df = docs([(None, text), (None, text), (None, text + " x"), (7, "other words"), (None, "other words")])
    assert sorted((r.doc_id or 0, r.text) for r in resemblance.keep_one(df).collect()) == [(0, text), (0, text + " x"), (7, "other words")]
    assert resemblance.keep_one(df.where("doc_id < 0")).count() == 0


def test_simhash_links_reach_the_stage(spark, docs, monkeypatch):
    """Without MinHash keys the groups are those that SimHash links and the similarity confirms."""
    monkeypatch.setattr(resemblance, "bands", lambda hashes: [])
    words = [f"w{k}" for k in range(400)]
    rows = [(1, " ".join(words)), (2, " ".join([*words, "last"])), (3, "quite another text"), (4, "QUITE another  text")]
    kept = corpus_pipeline.drop_near_duplicates(spark, docs(rows), "")
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3]


def test_chain_is_one_group():
    sets = [np.arange(a, a + 100, dtype="<u8") for a in range(0, 100, 10)] + [np.arange(5000, 5009, dtype="<u8")]
    assert resemblance.reached(sets).tolist() == [0] * 10 + [10]


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test data not present")
def test_no_similar_pair_is_left_in_the_given_table(spark):
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{FOLDER}/documents.parquet'").fetchall()
    want = brute(rows)
    got = {r.doc_id: r.component_id for r in resemblance.grouped(spark.read.parquet(f"{FOLDER}/documents.parquet")).collect()}
    assert got == want
