"""The mix against plain Python, and its properties."""

from __future__ import annotations

import math
import re
from collections import Counter
from fractions import Fraction

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tillframe.llm import mixing

WEIGHTS = mixing.WEIGHTS


def plain_targets(sizes: dict) -> dict:
    """Round by round: excess over the stop is dealt again by weight."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode("utf-32-be")))
    weight = {s: Fraction(WEIGHTS[i % 3]) for i, s in enumerate(names)}
    total = Fraction(3, 2) * sum(sizes.values())
    target = {s: Fraction(0) for s in names}
    open_, left = set(names), total
    while left > 0 and open_:
        share = left / sum(weight[s] for s in open_)
        left = Fraction(0)
        for s in list(open_):
            target[s] += share * weight[s]
            if target[s] > 2 * sizes[s]:
                left += target[s] - 2 * sizes[s]
                target[s] = Fraction(2 * sizes[s])
                open_.discard(s)
    return target


@given(st.dictionaries(st.sampled_from(["a", "B", "é", "z9", None, "", "src10", "src2"]), st.integers(0, 500), max_size=8))
@settings(max_examples=12, deadline=None)
def test_targets_equal_plain_dealing(spark, sizes):
    rows = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")
    got = {r.source: r.target for r in mixing.targets(rows).collect()}
    want = plain_targets(sizes)
    assert got.keys() == want.keys()
    assert all(math.isclose(got[s], want[s], rel_tol=1e-12, abs_tol=1e-9) for s in want)


def corpus():
    rows = [(i, "word " * (1 + i * 7 % 40), ["src0", "src1", "src2", None][0 if i % 3 == 0 else i % 4]) for i in range(400)]
    return rows + [(400, None, "src1"), (401, "", "src1"), (5, rows[5][1], rows[5][2]), (None, "a b", "src2"), (402, "# # #", "lone")]


def test_mix_meets_its_targets(docs):
    rows = corpus()
    got = mixing.plan_mix(docs(rows, clashing=True)).collect()
    assert len(got) == len(rows)
    sizes = Counter()
    for _, text, source in rows:
        sizes[source] += len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    want = plain_targets(sizes)
    taken = Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and math.isclose(r.target, want[r.source], rel_tol=1e-12)
        assert r.taken in (0, r.size, 2 * r.size)
        taken[r.source] += r.taken
    assert all(abs(taken[s] - want[s]) <= 20 for s in want)  # half of the longest document
    again = mixing.plan_mix(docs(rows[::-1])).collect()
    assert sorted((r.doc_id or -1, r.taken) for r in again) == sorted((r.doc_id or -1, r.taken) for r in got)


def test_rows_are_repeated_as_planned(docs):
    df = docs(corpus(), clashing=True)
    plan = Counter()
    for r in mixing.plan_mix(df).collect():
        plan[r.doc_id] += r.taken
    mixed = mixing.mixed(df)
    assert mixed.columns == df.columns
    got = Counter()
    for r in mixed.collect():
        got[r.doc_id] += len((r.text or "").split())
    assert got == +plan


def test_better_texts_are_drawn_more_often(spark):
    rows = spark.range(4000).select(
        F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.lit(1).cast("long").alias("size"),
        (-F.log(mixing.uniform(F.col("id"))) / F.when(F.col("id") % 2 == 0, 1.0).otherwise(0.1)).alias("sample_key"),
    )
    got = mixing.mix(rows).where("extra = 1").groupBy((F.col("doc_id") % 2).alias("odd")).count().collect()
    counts = {r.odd: r["count"] for r in got}
    assert counts[0] > 4 * counts[1] and sum(counts.values()) == 2000  # half a source beyond one epoch


def test_empty_and_wordless(docs):
    assert mixing.plan_mix(docs([(1, "a")]).where("doc_id < 0")).count() == 0
    got = mixing.plan_mix(docs([(1, None), (2, "")])).collect()
    assert [(r.target, r.taken) for r in got] == [(0.0, 0), (0.0, 0)]
    assert mixing.mixed(docs([(1, None), (2, "")])).count() == 0


def test_native(docs):
    plan = mixing.plan_mix(docs([(1, "a b")]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan
