"""Fixed patterns against the plain expressions, gradients, decoding, windows, whole texts."""

from __future__ import annotations

import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tillframe.llm import pii

PLAIN = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def plain_spans(text):
    found = []
    for k, (kind, pattern) in enumerate(PLAIN.items()):
        for m in pattern.finditer(text):
            digits = re.sub("[^0-9]", "", m[0])
            twice = [int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(digits))]
            if {
                "email": lambda: True,
                "ip": lambda: all(int(p) <= 255 for p in m[0].split(".")),
                "card": lambda: 14 <= len(digits) <= 19 and sum(twice) % 10 == 0,
                "phone": lambda: 10 <= len(digits) <= 15,
            }[kind]():
                found.append((m.start(), k, m.end()))
    return [(list(PLAIN)[k], a, b) for a, k, b in sorted(found)]


PIECES = ["a", "B9", "@", ".", "-", "+", " ", "(", ")", "%", "é", "1", "25", "255", "256", "0", "4387513035237269", "4387 5130-3523 7269", "x@y.z", "+1 (988) 555-2485", "10.2.3.4"]


@given(st.lists(st.sampled_from(PIECES), max_size=25).map("".join))
@settings(max_examples=600, deadline=None)
def test_patterns(text):
    assert pii.base_spans(text) == plain_spans(text)


def test_long_runs_take_no_time():
    for text in ("a" * 300_000, "9" * 300_000, "1." * 150_000, "a@" * 150_000, "a.b" * 100_000 + "@", "+1 " * 100_000):
        pii.base_spans(text)


def test_gradients():
    tagger = pii.new_tagger(3)
    tagger.params = [p.astype(np.float64) for p in tagger.params]
    rng = np.random.default_rng(4)
    x = rng.integers(0, pii.CLASSES, (7, 3))
    y = np.zeros((7, 3), np.int64)
    y[2:4, 0], y[2, 0], y[5, 1] = 2, 1, 3
    _, grads = tagger.loss(x, y)
    for k, p in enumerate(tagger.params):
        for _ in range(4):
            at = tuple(rng.integers(0, n) for n in p.shape)
            old, eps = p[at], 1e-2
            p[at] = old + eps
            up = tagger.loss(x, y)[0]
            p[at] = old - eps
            down = tagger.loss(x, y)[0]
            p[at] = old
            assert abs((up - down) / (2 * eps) - grads[k][at]) < 2e-3


def test_decoding_is_the_best_path():
    import itertools

    tagger = pii.new_tagger(5)
    tagger.params[6] *= 8
    x = np.random.default_rng(1).integers(0, pii.CLASSES, (3, 4))
    labels, _ = tagger.decode(x)
    e, _ = tagger.emissions(x)
    trans = tagger.params[8] + pii.allowed()
    for n in range(4):
        def score(path, n=n):
            return sum(e[t, n, k] for t, k in enumerate(path)) + sum(trans[a, b] for a, b in zip(path, path[1:]))

        best = max(itertools.product(range(pii.LABELS), repeat=3), key=score)
        assert abs(score(labels[:, n]) - score(best)) < 1e-4


def texts(n=260, seed=7):
    import random

    rng = random.Random(seed)
    made = []
    for i in range(n):
        words = ["lorem", "ipsum", "dolor", "Größe", "3.0", "sit", "amet,", "version", "12"]
        text = [rng.choice(words) for _ in range(rng.randrange(0, 90))]
        for _ in range(rng.randrange(0, 4)):
            text.insert(rng.randrange(len(text) + 1), rng.choice([
                f"{rng.choice('abcd')}{rng.choice('xyz')}.{rng.randrange(90)}@mail{rng.randrange(9)}.example.com",
                ".".join(str(rng.randrange(256)) for _ in range(4)),
                f"+1 ({rng.randrange(200, 999)}) 555-{rng.randrange(1000, 9999)}",
                rng.choice(["4387513035237269", "4799134681044206", "4232245145735943"]),
            ]))
        made.append((i, " ".join(text)))
    return made


@pytest.fixture(scope="module")
def tagger():
    rows = [w for i, t in texts(700) for w in pii.training_windows(t, np.random.default_rng(i))][: pii.TRAIN_WINDOWS]
    return pii.fit_tagger(np.array([r[0] for r in rows]), np.array([r[1] for r in rows]))


def test_network_finds_spans_in_other_texts(tagger):
    unseen = [t for _, t in texts(80, seed=99)]
    base = [set(pii.base_spans(t)) for t in unseen]
    tagged = pii.tagged_spans(unseen, tagger)
    found = sum(len(b & set(t)) for b, t in zip(base, tagged))
    assert found > 0.85 * sum(map(len, base))
    assert sum(len(set(t) - b) for b, t in zip(base, tagged)) < 0.1 * found


def test_all_windows_give_the_same(tagger, monkeypatch):
    some = [t + " " + "plain words " * k + t for k, (_, t) in enumerate(texts(60, seed=5))]
    pruned = pii.tagged_spans(some, tagger)
    monkeypatch.setattr(pii, "needed_windows", lambda n, anchors: np.arange(0, max(1, n - pii.WINDOW + pii.STEP), pii.STEP))
    assert pii.tagged_spans(some, tagger) == pruned


@pytest.mark.parametrize("form", ["jane [at] example.org", "jane(at)example.org"])
def test_changed_addresses_without_digits_are_found(tagger, form):
    text = f"lorem ipsum {form} dolor sit"
    assert ("email", 12, 12 + len(form)) in pii.tagged_spans([text], tagger)[0]
    far = "plain words " * 40 + text + " plain words" * 40
    assert ("email", 492, 492 + len(form)) in pii.tagged_spans([far], tagger)[0]


def test_result_does_not_depend_on_neighbours(tagger):
    some = [t for _, t in texts(30, seed=6)]
    together = pii.tagged_spans(some, tagger)
    assert together == [pii.tagged_spans([t], tagger)[0] for t in some]


def test_whole_table(spark, docs):
    rows = texts(120) + [(500, None), (501, ""), (502, "x " * 60_000 + "10.2.3.4"), (None, "a@b.cd"), (0, texts(1)[0][1])]
    df = docs(rows, clashing=True)
    got = pii.find_personal_data(df).collect()
    assert len(got) == len(rows)
    for r in got:
        text = next(t or "" for i, t in rows if i == r.doc_id)
        base = pii.written(plain_spans(text))
        spans = [s.split(":") for s in r.spans.split(",") if s]
        assert set(base.split(",")) - {""} <= set(r.spans.split(","))
        assert all(0 <= int(a) < int(b) <= len(text) and k in pii.KINDS for k, a, b in spans)
        assert r.n_ip == sum(k == "ip" for k, _, _ in plain_spans(text))
    assert pii.find_personal_data(df.where("doc_id < 0")).count() == 0
    assert pii.find_personal_data(docs([(1, "no digits here")])).first().spans == ""


def test_redaction():
    text = "mail a@b.cd or 10.0.0.1!"
    assert pii.redact(text, pii.base_spans(text)) == "mail [EMAIL] or [IP]!"
