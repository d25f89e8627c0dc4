"""Retrieval against plain scoring of every entry, and documents with planted items."""

from __future__ import annotations

import random
import re

import pytest

from tillframe.llm import decontaminate as d

WORDS = [f"{a}{b}" for a in ("ba", "co", "di", "fu", "ge", "ha") for b in ("l", "mm", "nor", "pst", "rk", "sti")]


def sentence(rng, n):
    # A few words are frequent, many are rare, as in a language.
    return " ".join(rng.choice(WORDS[:6]) if rng.random() < 0.5 else rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))


def items(n, seed=1):
    rng = random.Random(seed)
    made = []
    for i in range(n):
        question = sentence(rng, rng.randrange(6, 90)).capitalize()
        made.append((i, f"{question}? {sentence(rng, rng.randrange(2, 12)).capitalize()}."))
    return made


@pytest.mark.parametrize("seed", range(6))
def test_wand_finds_all_above_threshold(seed):
    rng = random.Random(seed)
    index = d.Index(items(150, seed))
    entries = len(index.item_of)
    for _ in range(30):
        terms = sorted(rng.sample(range(len(index.terms)), rng.randrange(1, 120)))
        score = [0.0] * entries
        for t in terms:
            for doc, w in zip(index.docs[t], index.weights[t]):
                score[doc] += w
        for threshold in (0.02, 0.1, 0.3):
            first, last = sorted((rng.randrange(entries + 1), rng.randrange(entries + 1)))
            want = {k: s for k, s in enumerate(score) if s >= threshold and first <= k < last}
            got = dict(index.retrieve(terms, threshold, first, last))
            assert got.keys() == want.keys()
            assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


def grams(words, n=5):
    n = min(n, len(words))
    return {tuple(words[k : k + n]) for k in range(len(words) - n + 1)} if n else set()


def brute(docs_rows, item_rows):
    """Plain containment: four fifths of the item's runs of five words, or of its question's and its answer's, are in the text."""
    parts = []
    for i, text in item_rows:
        sentences = [re.findall(r"\w+", p.lower()) for p in re.split(r"(?<=[.!?])\s+|\n+", text or "")]
        sentences = [p for p in sentences if p]
        words = sum(sentences, [])
        answer = sentences[-1] if len(sentences) > 1 else words[len(words) - len(words) // 3 :]
        if words:
            parts.append((i, len(words), grams(words), grams(words[: len(words) - len(answer)]), grams(answer)))
    found = set()
    for doc_id, text in docs_rows:
        words = re.findall(r"\w+", (text or "").lower())
        runs = set().union(*[grams(words, n) for n in range(1, 6)]) if words else set()
        for i, n, *groups in parts:
            whole, question, answer = (len(g & runs) / len(g) if g else 1.0 for g in groups)
            if whole >= 0.8 or (n >= 5 and question >= 0.8 and answer >= 0.8):
                found.add((doc_id, i))
    return found


def planted(n=60, seed=5):
    rng = random.Random(seed)
    bench = items(80, seed)
    rows = []
    for i in range(n):
        parts = [sentence(rng, rng.randrange(0, 300))]
        if i % 3 == 0:
            parts.append(rng.choice(bench)[1].upper().replace(" ", "\n") if i % 2 else rng.choice(bench)[1])
        if i % 7 == 0:
            parts.append(rng.choice(bench)[1][:60])  # a fragment is no leak
        if i % 5 == 0:  # one changed word in a whole item
            words = rng.choice(bench)[1].split()
            words[-2] = "changed"
            parts.append(" ".join(words))
        rows.append((i, " ".join([*parts, sentence(rng, rng.randrange(0, 300))])))
    return rows, bench


def test_planted_items_are_found(spark, docs):
    rows, bench = planted()
    extra = [(900, None), (901, ""), (902, "one word"), (None, bench[3][1]), (rows[0][0], rows[0][1]), (903, sentence(random.Random(1), 90_000) + " " + bench[7][1])]
    odd = [(500, None), (501, ""), (502, "too short here"), (503, bench[7][1]), (None, bench[7][1])]
    df = docs(rows + extra, clashing=True)
    items_df = spark.createDataFrame(bench + odd, "item_id long, text string")
    got = d.contamination(df, items_df)
    assert got.columns == ["doc_id", "item_id", "score", "question_overlap", "answer_overlap", "item_overlap"]
    got = got.collect()
    pairs = {(r.doc_id, r.item_id) for r in got}
    assert pairs == brute(rows + extra, bench + odd)
    assert {(903, 7), (903, 503), (903, None), (None, 3)} <= pairs
    assert all({(i, b) for b, t in bench if t in x} <= pairs for i, x in rows)
    kept = d.drop_contaminated(df, items_df)
    assert kept.columns == df.columns
    bad = {r.doc_id for r in got}
    assert sorted(map(repr, (r.doc_id for r in kept.collect()))) == sorted(repr(i) for i, _ in rows + extra if i not in bad)


def test_blocks_do_not_change_pairs_or_scores(spark, docs, monkeypatch):
    rows, bench = planted(30)
    items_df = spark.createDataFrame(bench + [(700, "Who wrote Faust? Goethe"), (701, None)], "item_id long, text string").repartition(3)
    df = docs(rows + [(950, "so who wrote FAUST goethe did")])
    whole = sorted(map(tuple, d.contamination(df, items_df).collect()))
    monkeypatch.setattr(d, "ITEM_BLOCK", 17)  # five blocks
    parts = sorted(map(tuple, d.contamination(df, items_df).collect()))
    assert len(list(d.indexes(items_df))) == 5
    assert [r[:2] for r in whole] == [r[:2] for r in parts] and (950, 700) in {r[:2] for r in parts}
    assert all(abs(a - b) < 1e-12 for r, s in zip(whole, parts) for a, b in zip(r[2:], s[2:]))
    bad = {r[0] for r in whole}
    assert {r.doc_id for r in d.drop_contaminated(df, items_df).collect()} == {i for i, _ in rows} - bad


def test_short_items_are_whole_runs(spark, docs):
    items_df = spark.createDataFrame([(1, "Who wrote Faust? Goethe"), (2, "one two"), (3, "solo"), (4, " . ")], "item_id long, text string")
    df = docs([(1, "I ask who wrote Faust? Goethe!"), (2, "who wrote faust, then: goethe"), (3, "two one, one"), (4, "ONE--two"), (5, "solos"), (6, "Solo."), (7, None)])
    got = {(r.doc_id, r.item_id) for r in d.contamination(df, items_df).collect()}
    assert got == {(1, 1), (4, 2), (6, 3)}


def test_one_changed_word_in_the_answer(spark, docs):
    question = " ".join(f"q{k}" for k in range(27)) + "?"
    answer = " ".join(f"a{k}" for k in range(11)) + "."
    df = docs([(1, f"before {question} {answer.replace('a5', 'other')} after"), (2, f"before {question} after"), (3, answer)])
    items_df = spark.createDataFrame([(9, f"{question} {answer}")], "item_id long, text string")
    hit = d.contamination(df, items_df).collect()
    assert [(r.doc_id, r.item_id) for r in hit] == [(1, 9)]
    assert hit[0].answer_overlap < 0.8 < hit[0].item_overlap


def test_empty_sides(spark, docs):
    none = spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame(items(3), "item_id long, text string")
    df = docs([(1, "a b c d e f"), (2, None)])
    assert d.contamination(df, none).count() == 0 and d.drop_contaminated(df, none).count() == 2
    assert d.contamination(df.where("doc_id < 0"), some).count() == 0


def test_question_and_answer():
    assert d.question_answer("What is it? It is that.") == (["what", "is", "it"], ["it", "is", "that"])
    assert d.question_answer("a b c d e f") == (["a", "b", "c", "d"], ["e", "f"])
    assert d.question_answer("") == ([], [])
