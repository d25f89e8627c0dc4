"""The chain of classifiers: held-out accuracy, out-of-fold inputs, defined edge cases."""

from __future__ import annotations

import random

import numpy as np
import pytest

from tillframe.llm import toxicity

BAD = sum(toxicity.CATEGORY_TERMS.values(), ())


def corpus(n=500, seed=1):
    rng = random.Random(seed)
    words = [f"{a}{b}" for a in ("ro", "mi", "ta", "ne", "lu") for b in ("ka", "so", "ren", "tin", "mel", "dar")]
    rows, labels = [], []
    for i in range(n):
        text = [rng.choice(words) for _ in range(rng.randrange(5, 120))]
        toxic = int(rng.random() < 0.25)
        if toxic:
            for _ in range(rng.randrange(1, 4)):
                text.insert(rng.randrange(len(text)), rng.choice(BAD).upper() if rng.random() < 0.2 else rng.choice(BAD))
        rows.append((i, " ".join(text)))
        labels.append((i, toxic))
    return rows, labels


def test_held_out_accuracy_and_edge_cases(spark, docs):
    rows, labels = corpus()
    labels_df = spark.createDataFrame([(i, 1, t) for i, t in labels[:300]] + [(9999, 1, 1), (None, 0, 0)], "doc_id long, quality int, toxic int")
    long = ("roka miso " * 60_000, "roka miso " * 60_000 + " idiot")
    extra = [(1000, None), (1001, ""), (1002, "1 2 3"), (1003, long[0]), (1004, long[1]), (None, "you moron"), (rows[0][0], rows[0][1])]
    df = docs(rows + extra, clashing=True)
    got = toxicity.score_toxicity(df, labels_df)
    assert got.columns == ["doc_id", "insult", "degrading", "toxic", "rejected"]
    got = got.collect()
    assert len(got) == len(rows) + len(extra)
    by = {r.doc_id: r for r in got}
    right = [by[i].rejected == bool(t) for i, t in labels[300:]]
    assert np.mean(right) > 0.97
    assert not by[1000].rejected and by[1000].toxic == by[1001].toxic == by[1002].toxic
    assert not by[1003].rejected and by[1004].rejected and by[None].rejected
    kept = toxicity.drop_toxic(df, labels_df)
    assert kept.columns == df.columns
    assert sorted(map(repr, (r.doc_id for r in kept.collect()))) == sorted(repr(r.doc_id) for r in got if not r.rejected)


@pytest.mark.parametrize("label,rejected", [([], False), ([(1, 1, 0)], False), ([(1, 1, 1)], True)])
def test_labels_of_one_class(spark, docs, label, rejected):
    labels = spark.createDataFrame(label, "doc_id long, quality int, toxic int")
    got = toxicity.score_toxicity(docs([(1, "a b"), (2, "c")]), labels).collect()
    assert [r.rejected for r in got] == [rejected] * 2


def test_empty_documents(spark, docs):
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    assert toxicity.score_toxicity(docs([(1, "a")]).where("doc_id < 0"), labels).count() == 0


def test_categories_tell_apart():
    rng = random.Random(3)
    names = list(toxicity.CATEGORY_TERMS)
    lists, y = [], {c: [] for c in (*names, "toxic")}
    for _ in range(400):
        kinds = [c for c in names if rng.random() < 0.3]
        words = [f"plain{rng.randrange(30)}" for _ in range(20)] + [rng.choice(toxicity.CATEGORY_TERMS[c]) for c in kinds]
        lists.append(toxicity.text_features(" ".join(words)))
        for c in names:
            y[c].append(float(c in kinds))
        y["toxic"].append(float(bool(kinds)))
    chain = toxicity.fit_chain(lists, {c: np.array(v) for c, v in y.items()})
    insult = chain.probabilities([f for f in toxicity.text_features("you idiot") if f in chain.weights])
    scum = chain.probabilities([f for f in toxicity.text_features("utter scum") if f in chain.weights])
    assert insult[0] > 0.5 > insult[1] and scum[1] > 0.5 > scum[0]
    assert min(insult[2], scum[2]) >= chain.threshold > chain.probabilities([])[2]
    # The verdict uses what the earlier models said.
    assert len(chain.dense[2]) == 2 and (chain.dense[2] > 0).any()


def test_unknown_labels_are_left_out():
    lists = [toxicity.text_features(t) for t in ("a b idiot", "a b", "b c idiot", "c a") * 10]
    toxic = np.array([1.0, 0, 1, 0] * 10)
    some = toxic.copy()
    some[:20] = np.nan
    chain = toxicity.fit_chain(lists, {"insult": some, "toxic": toxic})
    assert chain.probabilities([f for f in lists[0] if f in chain.weights])[1] >= chain.threshold


def test_threshold_is_in_the_gap():
    assert toxicity.cut(np.array([0.1, 0.2, 0.8, 0.9]), np.array([0.0, 0, 1, 1])) == 0.5
    assert toxicity.cut(np.array([0.1, 0.2]), np.array([1.0, 1.0])) == 0.5
