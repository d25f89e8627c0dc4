"""The registered queries: SQL where there is some, brute force or planted truth elsewhere, on the given tables."""

from __future__ import annotations

import hashlib
import html
import os
import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from check_oracle import compare, connect
from tests.llm.test_decontaminate import brute
from tests.llm.test_resemblance import brute as similar_groups
from tests.llm.test_simhash import plain_fingerprint
from tillframe.llm import queries as q

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test data not present")


def table(name, columns):
    return duckdb.sql(f"SELECT {columns} FROM '{FOLDER}/{name}.parquet'").fetchall()


@pytest.mark.parametrize("name", sorted(q.ORACLE))
def test_query_equals_sql(spark, name):
    assert compare(spark, connect(FOLDER), FOLDER, name) is None


def test_personal_data(spark):
    texts = dict(table("documents", "doc_id, coalesce(text, '')"))
    patterns = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }

    def holds(kind, text):
        digits = [int(c) for c in text if c.isdigit()]
        if kind == "ip":
            return all(int(p) <= 255 for p in text.split("."))
        if kind == "card":
            return 14 <= len(digits) <= 19 and (sum(digits[-1::-2]) + sum(sum(divmod(2 * d, 10)) for d in digits[-2::-2])) % 10 == 0
        return kind == "email" or 10 <= len(digits) <= 15

    got = q.op1_pii(spark, FOLDER).collect()
    assert len(got) == len(texts)
    for r in got:
        text = texts[r.doc_id]
        spans = [(m.start(), k, m.end()) for k, (kind, p) in enumerate(patterns.items()) for m in re.finditer(p, text) if holds(kind, m[0])]
        base = ",".join(f"{list(patterns)[k]}:{a}:{b}" for a, k, b in sorted(spans))
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert set(base.split(",")) - {""} <= set(r.spans.split(","))
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[1] == k for s in spans) for k in range(4)]


def test_quality(spark):
    labels = dict(table("labels", "doc_id, quality"))
    got = q.op3_quality(spark, FOLDER).collect()
    assert sorted(r.doc_id for r in got) == sorted(i for (i,) in table("documents", "doc_id"))
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    known = [(labels[r.doc_id], r.predicted) for r in got if r.doc_id in labels]
    assert np.mean([a == b for a, b in known]) > 0.85


def test_simhash(spark):
    rows = table("documents", "doc_id, text")
    prints = {i: plain_fingerprint(t) for i, t in rows}
    got = {r.doc_id: r for r in q.op4_simhash(spark, FOLDER).collect()}
    assert {i: r.fingerprint for i, r in got.items()} == {i: f"{p:016x}" for i, p in prints.items()}
    for a, p in prints.items():
        for b, o in prints.items():
            if bin(p ^ o).count("1") <= 3:
                assert got[a].component_id == got[b].component_id <= min(a, b)


def test_pages(spark):
    pages = dict(table("pages", "page_id, html"))
    for r in q.op6_html(spark, FOLDER).collect():
        article = pages[r.page_id].split("<article>")[1].split("</article>")[0]
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", " ", b)).split()) for b in re.split("</?(?:p|h1)>", article)]
        assert r.text == "\n".join(filter(None, blocks)) and r.n_chars == len(r.text)


def test_sharding(spark):
    got = q.op7_sharding(spark, FOLDER).collect()
    sizes = [sum(r.size for r in got if r.shard == k) for k in range(8)]
    longest = max(r.size for r in got)
    assert max(sizes) - min(sizes) <= longest and {r.law for r in got} == {"bytes"}
    assert all(sorted(r.slot for r in got if r.shard == k) == list(range(sum(r.shard == k for r in got))) for k in range(8))


def test_embeddings(spark):
    rows = table("embeddings", "vec_id, label, embedding")
    vectors = {i: (label, np.array(v, float)) for i, label, v in rows}
    links = defaultdict(set)
    for i, (a, u) in vectors.items():
        for j, (b, v) in vectors.items():
            if i != j and a == b and u @ v / np.linalg.norm(u) / np.linalg.norm(v) >= 0.93:
                links[i].add(j)
    for r in q.op9_embeddings(spark, FOLDER).collect():
        assert r.n_links == len(links[r.vec_id]) and r.kept == (r.vec_id == r.component_id)


def test_decontamination(spark):
    got = {(r.doc_id, r.item_id) for r in q.op10_decontamination(spark, FOLDER).collect()}
    assert got == brute(table("documents", "doc_id, text"), table("benchmark", "item_id, text"))


def test_pipeline_stage_by_stage(spark):
    """Every stage does its own work on all that the one before kept."""
    rows = dict(table("documents", "doc_id, text"))
    rejected = {r.doc_id for r in q.op2_toxicity(spark, FOLDER).collect() if r.rejected}
    bench = table("benchmark", "item_id, text")
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns = docs.columns
    stage = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "mixing", "sharding"]
    docs = stage["toxicity"](spark, docs, FOLDER).cache()
    left = {r.doc_id for r in docs.collect()}
    assert left == set(rows) - rejected and docs.columns == columns
    docs = stage["near_duplicates"](spark, docs, FOLDER).cache()
    kept = {r.doc_id for r in docs.collect()}
    groups = similar_groups([(i, rows[i]) for i in left])  # smallest id of the five-word Jaccard group
    assert kept == set(groups.values()) and len(kept) < len(left) and docs.columns == columns
    docs = stage["decontamination"](spark, docs, FOLDER).cache()
    clean = {r.doc_id for r in docs.collect()}
    assert clean == kept - {i for i, _ in brute([(i, rows[i]) for i in kept], bench)} and docs.columns == columns
    docs = stage["mixing"](spark, docs, FOLDER).cache()
    assert {r.doc_id for r in docs.collect()} <= clean and docs.columns == columns
    placed = stage["sharding"](spark, docs, FOLDER)
    assert placed.count() == docs.count() == corpus_pipeline.run(spark, FOLDER).count()
