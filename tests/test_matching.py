from __future__ import annotations

import collections
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from tillframe.operators import matching

ERP = [
    "BLUE ENAMEL COFFEE POT LARGE",
    "SET OF SIX OAK SPOONS",
    "GARDEN LANTERN WITH CANDLE",
    "STRIPED COTTON KITCHEN TOWEL",
    "LARGE BLUE COFFEE MUG",
]
REVIEWED = [
    "Blue Enamel Coffeepot Large",
    "Six Oak Spoons Set",
    "Garden Lantern",
    "Striped Cotton Towel",
    "An Unrelated Article Entirely",
]


def names(spark, values):
    return spark.createDataFrame(list(enumerate(values)), "idx long, name string")


def products(spark, values, codes=None):
    codes = codes or [f"{i + 1:03d}" for i in range(len(values))]
    return spark.createDataFrame(
        [(i, c, n, "Category") for i, (c, n) in enumerate(zip(codes, values))],
        "idx long, product_id string, product_name string, category string",
    )


def found(df):
    return {r.idx: (r.match_idx, r.score) for r in df.collect()}


# --- plain re-computations ---------------------------------------------------


def grams(text):
    out = collections.Counter()
    for word in text.lower().split():
        padded = f" {word} "
        for n in (2, 3, 4):
            out.update(padded[i : i + n] for i in range(len(padded) - n + 1))
    return out


def unit_vectors(left, right):
    docs = [grams(t) for t in left + right]
    df = collections.Counter(g for d in docs for g in d)

    def unit(d):
        w = {g: c * (math.log((1 + len(docs)) / (1 + df[g])) + 1) for g, c in d.items()}
        length = math.sqrt(sum(x * x for x in w.values()))
        return {g: x / length for g, x in w.items()} if length else {}

    vectors = [unit(d) for d in docs]
    return vectors[: len(left)], vectors[len(left) :]


def plain_tfidf(left, right, t, skip_self=False):
    a, b = unit_vectors(left, right)
    out = {}
    for i, x in enumerate(a):
        scored = [(-round(sum(v * y.get(g, 0.0) for g, v in x.items()), 6), j) for j, y in enumerate(b) if not (skip_self and i == j)]
        if scored and -min(scored)[0] >= t:
            out[i] = (min(scored)[1], round(-min(scored)[0], 4))
    return out


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
        row = new
    return row[-1]


def plain_fuzzy(values, t):
    keys = [" ".join(sorted(v.split())) for v in values]
    out = {}
    for i, a in enumerate(keys):
        best, where = 0.0, -1
        for j, b in enumerate(keys):
            if i == j:
                continue
            score = 200 * lcs(a, b) / (len(a) + len(b)) if a or b else 100.0
            if score > best + 1e-9:
                best, where = score, j
        if best >= t - 1e-9 and 0 <= where < i:
            out[i] = (where, round(best / 100, 4))
    return out


def close(got, want):
    assert got.keys() == want.keys()
    for k in got:
        assert got[k][0] == want[k][0] and got[k][1] == pytest.approx(want[k][1], abs=2e-4), k


def random_names(seed, count):
    rng = random.Random(seed)
    words = ["red", "blue", "heart", "hearts", "mug", "mugs", "lamp", "a", "of", "bag", "bags", "box", "t-light", "holder"]
    return [" ".join(rng.choices(words, k=rng.randint(1, 4))).upper() for _ in range(count)]


# --- exact codes -----------------------------------------------------------------


def test_hard_match_groups_variants(spark):
    df = products(spark, ["A", "B", "C", "D", "E"], ["85123A", "85123b", "85123", "post", "DOT"])
    # post and DOT both normalise to nothing and so form a group
    assert found(matching.hard_match(df)) == {1: (0, 1.0), 2: (0, 1.0), 4: (3, 1.0)}


# --- edit similarity ----------------------------------------------------------------


def test_bit_parallel_lcs():
    rng = random.Random(5)
    for _ in range(500):
        a = "".join(rng.choices("abc ", k=rng.randint(0, 12)))
        b = "".join(rng.choices("abc ", k=rng.randint(0, 12)))
        assert matching._lcs(a, b) == lcs(a, b)


@pytest.mark.parametrize("seed,threshold", [(1, 80), (2, 80), (3, 90), (4, 76), (5, 60), (6, 45)])
def test_fuzzy_match_misses_nothing(spark, seed, threshold):
    values = random_names(seed, 120)
    close(found(matching.fuzzy_match(products(spark, values), threshold)), plain_fuzzy(values, threshold))


def test_fuzzy_match_on_very_short_and_odd_names(spark):
    rng = random.Random(9)
    values = ["".join(rng.choices("ab c", k=rng.randint(0, 5))).strip() for _ in range(60)]
    values += ["AC", "ABC", "x", "y", "", "É TE", "TE É"]
    for t in (80, 67):
        close(found(matching.fuzzy_match(products(spark, values), t)), plain_fuzzy(values, t))


def test_fuzzy_is_case_sensitive_and_ignores_word_order(spark):
    df = products(spark, ["RED MUG BIG", "BIG RED MUG", "big red mug"])
    assert found(matching.fuzzy_match(df)) == {1: (0, 1.0)}


# --- TF-IDF ------------------------------------------------------------------------------


def test_obvious_match(spark):
    got = found(matching.tfidf_match(names(spark, ERP), names(spark, REVIEWED), threshold=0.3))
    assert got[0][0] == 0 and got[0][1] > 0.5
    close(got, plain_tfidf(ERP, REVIEWED, 0.3))


@pytest.mark.parametrize("threshold", [0.05, 0.25, 0.6, 0.95])
def test_cross_match_equals_all_pairs(spark, threshold):
    left, right = random_names(11, 60), random_names(12, 70)
    got = found(matching.tfidf_match(names(spark, left), names(spark, right), threshold=threshold))
    close(got, plain_tfidf(left, right, threshold))


def test_other_match_equals_all_pairs(spark):
    values = random_names(13, 80) + ["", "Q", "RED MUG", "MUG RED"]
    got = found(matching.tfidf_match(names(spark, values), threshold=0.2, include_self=False))
    close(got, plain_tfidf(values, values, 0.2, skip_self=True))


def test_self_match_is_the_first_name_with_the_same_words(spark):
    got = found(matching.tfidf_match(names(spark, ["RED MUG", "BAG", "mug  red", "", "RED MUG"])))
    assert got == {0: (0, 1.0), 1: (1, 1.0), 2: (0, 1.0), 4: (0, 1.0)}


def test_lower_threshold_matches_no_fewer(spark):
    low = matching.tfidf_match(names(spark, ERP), names(spark, REVIEWED), threshold=0.01).count()
    high = matching.tfidf_match(names(spark, ERP), names(spark, REVIEWED), threshold=0.99).count()
    assert low >= high


def test_empty_inputs(spark):
    assert matching.tfidf_match(names(spark, []), names(spark, [])).count() == 0
    assert matching.fuzzy_match(products(spark, [])).count() == 0


# --- mapping ---------------------------------------------------------------------------------


def test_golden_records_priority(spark):
    df = products(
        spark,
        ["RED MUG LARGE", "BLUE BAG", "RED MUG LARGES", "RED MUG LARGE", "", "OTHER"],
        ["1A", "2", "3", "1B", "5", "6"],
    )
    got = {r.mapping_id: r for r in matching.golden_records(df).collect()}
    assert [got[i].match_strategy for i in range(1, 7)] == ["tfidf", "tfidf", "fuzzy", "hard", "rank", "tfidf"]
    assert [got[i].review_code for i in range(1, 7)] == ["REV_0001", "REV_0002", "REV_0001", "REV_0001", "REV_0005", "REV_0006"]
    assert got[3].match_score == pytest.approx(0.963, abs=1e-3) and got[5].match_score == 0.0
    assert all(r.golden_name == r.product_name for r in got.values())


def test_golden_records_rank_only(spark):
    got = matching.golden_records(products(spark, ERP), strategy="poc").collect()
    assert {r.match_strategy for r in got} == {"rank"} and {r.match_score for r in got} == {0.0}
    assert len({r.product_id for r in got}) == len(got) == 5


def test_review_codes_wrap_after_a_thousand(spark):
    df = spark.createDataFrame([(0,), (999,), (1000,)], "idx long")
    assert [r.c for r in df.select(matching.review_code(F.col("idx")).alias("c")).collect()] == ["REV_0001", "REV_1000", "REV_0001"]


def test_unknown_strategy(spark):
    with pytest.raises(ValueError):
        matching.golden_records(products(spark, ERP), strategy="magic")


def mapping(spark, values):
    return matching.golden_records(products(spark, values), strategy="poc")


def test_round_robin(spark):
    reviews = spark.range(7).select((F.col("id") * 10).alias("review_key"))
    got = sorted((r.review_key, r.review_id, r.review_code) for r in matching.attach_reviews_rr(reviews, mapping(spark, ERP[:3])).collect())
    assert got == [(i * 10, i + 1, f"REV_{i % 3 + 1:04d}") for i in range(7)]


def plain_attach(texts, product_names, limit):
    def terms(text):
        tokens = re.findall(r"\w\w+", text.lower())
        return tokens + [f"{a} {b}" for a, b in zip(tokens, tokens[1:])]

    docs = [collections.Counter(terms(t)) for t in product_names + texts]
    total = collections.Counter()
    for d in docs:
        total.update(d)
    kept = {t for t, _ in sorted(total.items(), key=lambda kv: (-kv[1], kv[0]))[: limit or None]}
    df = collections.Counter(t for d in docs for t in d if t in kept)

    def unit(d):
        w = {t: c * (math.log((1 + len(docs)) / (1 + df[t])) + 1) for t, c in d.items() if t in kept}
        length = math.sqrt(sum(x * x for x in w.values()))
        return {t: x / length for t, x in w.items()} if length else {}

    units = [unit(d) for d in docs]
    heads, bodies = units[: len(product_names)], units[len(product_names) :]
    return [min((-round(sum(v * h.get(t, 0) for t, v in b.items()), 6), i) for i, h in enumerate(heads))[1] for b in bodies]


@pytest.mark.parametrize("limit", [0, 5000, 12])
def test_word_assignment_equals_all_pairs(spark, limit):
    values = random_names(21, 15)
    texts = [f"I like the {n.lower()} very much" for n in random_names(22, 25)] + ["nothing here", "", "café É"]
    reviews = spark.createDataFrame(list(enumerate(texts)), "review_key long, review_text string")
    got = matching.attach_reviews_tfidf(reviews, mapping(spark, values), limit).collect()
    assert [r.product_idx for r in sorted(got, key=lambda r: r.review_key)] == plain_attach(texts, values, limit)
    assert all(r.review_code == f"REV_{r.product_idx + 1:04d}" for r in got)


def test_words_elsewhere_are_put_together_only_where_needed(spark, monkeypatch):
    made, each = [], matching._each
    monkeypatch.setattr(matching, "_each", lambda *args: made.append(each(*args)) or made[-1])
    common = " ".join(f"plain{i}" for i in range(10))
    texts = ["a garden lantern for plain3", "", None] + [f"{common} lamp{i} for plain3" for i in range(20)]
    reviews = spark.createDataFrame(list(enumerate(texts)), "review_key long, review_text string")
    got = {r.review_key: r.score for r in matching.attach_reviews_tfidf(reviews, mapping(spark, ERP[2:3])).collect()}
    name, text = ["garden", "lantern", "with", "candle"], ["garden", "lantern", "for", "plain3"]
    name, text = ([*t, *(f"{a} {b}" for a, b in zip(t, t[1:]))] for t in (name, text))
    held = {"for": 21, "plain3": 21, "for plain3": 21}
    idf = {t: math.log((1 + 24) / (1 + held.get(t, (t in name) + (t in text)))) + 1 for t in name + text}
    length = math.sqrt(sum(idf[t] ** 2 for t in name) * sum(idf[t] ** 2 for t in text))
    assert got == {0: round(sum(idf[t] ** 2 for t in set(name) & set(text)) / length, 6), **dict.fromkeys(range(1, 23), 0.0)}
    # Each of the other texts holds 24 terms; three of them are needed.
    assert made[-1].count() <= 20 * 5


def test_only_terms_of_names_get_rows(spark, monkeypatch):
    """Texts that all begin with a name: of their other terms no row is made."""
    made, each = [], matching._each
    monkeypatch.setattr(matching, "_each", lambda *args: made.append(each(*args)) or made[-1])
    texts = [f"Garden LANTERN {' '.join(f'plain{i % (k + 2)}x' for i in range(30))} lamp{k}" for k in range(20)]
    reviews = spark.createDataFrame(list(enumerate(texts)), "review_key long, review_text string")
    got = {r.review_key: r.score for r in matching.attach_reviews_tfidf(reviews, mapping(spark, ERP[2:3])).collect()}
    docs = [collections.Counter([*t, *(f"{a} {b}" for a, b in zip(t, t[1:]))]) for t in (x.lower().split() for x in texts)]
    name = collections.Counter(["garden", "lantern", "with", "candle", "garden lantern", "lantern with", "with candle"])
    df = collections.Counter(t for d in [*docs, name] for t in d)

    def length(d):
        return math.sqrt(sum((n * idf[t]) ** 2 for t, n in d.items()))

    idf = {t: math.log((1 + 21) / (1 + n)) + 1 for t, n in df.items()}
    assert got == {i: round(sum(d[t] * name[t] * idf[t] ** 2 for t in name) / length(d) / length(name), 6) for i, d in enumerate(docs)}
    assert sum(m.count() for m in made) <= len(name) + 3 * len(texts)


@pytest.mark.parametrize("few", [0, 1000])
def test_lengths_of_all_and_of_named_reviews_agree(spark, monkeypatch, few):
    """With repeated and missing keys and texts, whether all texts are packed or only those with a word of a name."""
    monkeypatch.setattr(matching, "FEW_TOUCHED", few)
    rows = [(1, "a garden lantern"), (1, "lantern for plain3"), (2, None), (3, "plain3 for all"), (4, "garden plain3 for"), (None, "lantern"), (None, "plain3")]
    reviews = spark.createDataFrame(rows, "review_key long, review_text string")
    got = sorted((r.review_key or 0, r.score) for r in matching.attach_reviews_tfidf(reviews, mapping(spark, ERP[2:3])).collect())
    split = [(k, [*t, *(f"{a} {b}" for a, b in zip(t, t[1:]))]) for k, t in ((k, re.findall(r"\w\w+", t or "")) for k, t in rows)]
    name = ["garden", "lantern", "with", "candle", "garden lantern", "lantern with", "with candle"]
    df = collections.Counter(t for d in [*(set(t) for _, t in split), name] for t in d)
    idf = {t: math.log((1 + 8) / (1 + n)) + 1 for t, n in df.items()}

    def score(key):
        uses = collections.Counter(t for k, d in split if k == key for t in d)
        length = math.sqrt(sum((n * idf[t]) ** 2 for t, n in uses.items()) * sum(idf[t] ** 2 for t in name))
        return round(sum(uses[t] * idf[t] ** 2 for t in name) / length, 6) if length else 0.0

    assert got == sorted([(0, 0.0), (0, 0.0), (1, score(1)), (1, score(1)), (2, 0.0), (3, 0.0), (4, score(4))])


def test_semantic_assign_falls_back_to_the_commonest(spark):
    targets = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "id long, vec array<double>")
    reviews = spark.createDataFrame(
        [(1, [2.0, 0.1]), (2, [0.1, 3.0]), (3, [0.0, 1.0]), (4, [-1.0, -1.0]), (5, [0.0, 0.0])], "id long, vec array<double>"
    )
    for block in (50_000, 1):
        got = {r.review_key: (r.product_idx, r.confident) for r in matching.semantic_assign(reviews, targets, 0.5, block).collect()}
        assert got == {1: (0, True), 2: (1, True), 3: (1, True), 4: (1, False), 5: (1, False)}


def test_semantic_assign_without_any_confident_review(spark):
    targets = spark.createDataFrame([(0, [1.0, 0.0])], "id long, vec array<double>")
    reviews = spark.createDataFrame([(1, [-1.0, 0.0])], "id long, vec array<double>")
    assert matching.semantic_assign(reviews, targets, 0.5).first().product_idx is None


def test_history_closes_and_opens(spark, rows):
    def mapped(data):
        return spark.createDataFrame(data, "product_id string, review_code string, golden_name string, match_score double, match_strategy string")

    old = mapped([("A", "R1", "a", 0.0, "rank"), ("B", "R2", "b", 0.0, "rank"), ("C", "R3", "c", 0.0, "rank")])
    first = F.lit("2024-01-01").cast("timestamp_ntz")
    history = old.withColumn("valid_from", first).withColumn("valid_to", F.lit(None).cast("timestamp_ntz"))
    new = mapped([("A", "R1", "a", 0.0, "rank"), ("B", "R9", "b", 1.0, "hard"), ("D", "R4", "d", 0.0, "rank")])
    once = matching.update_history(history, new, F.lit("2024-06-01").cast("timestamp_ntz"))
    state = sorted((r.product_id, r.review_code, r.valid_to is None) for r in once.collect())
    assert state == [("A", "R1", True), ("B", "R2", False), ("B", "R9", True), ("C", "R3", False), ("D", "R4", True)]
    again = matching.update_history(once, new, F.lit("2024-07-01").cast("timestamp_ntz"))
    assert rows(again) == rows(once)


def test_hybrid_routes(spark):
    values = ["RED MUG LARGE", "RED MUG LARGER", "BLUE LAMP SHADE", "BLUE BAG", "ZZZ"]
    got = {r.idx: r for r in matching.hybrid_match(products(spark, values), 0.05).collect()}
    assert got[0].match_idx == 1 and got[0].route == "auto"
    assert all(r.route == ("auto" if r.hybrid_score >= 0.7 else "manual_review" if r.hybrid_score >= 0.5 else "quarantine") for r in got.values())
    assert 4 not in got


def test_proportional_names_are_the_same(spark):
    """Twice the same words give the same direction: the first of such names wins."""
    values = ["MUG", "MUG MUG", "MUG LAMP", "LAMP MUG MUG LAMP", "MUG MUG MUG", "CUP"]
    got = found(matching.tfidf_match(names(spark, values)))
    close(got, plain_tfidf(values, values, 0.25))
    assert {i: m for i, (m, _) in got.items()} == {0: 0, 1: 0, 2: 2, 3: 2, 4: 0, 5: 5}
    other = found(matching.tfidf_match(names(spark, values), include_self=False))
    assert {i: other[i][0] for i in (0, 1, 2, 3, 4)} == {0: 1, 1: 0, 2: 3, 3: 2, 4: 0}


def test_words_of_a_text_are_cut_once_and_counted_where_they_lie(spark):
    """A plan that cuts a text per use, or sends all terms over the network to count them, grows far beyond its input."""
    texts = [(1, 1, "red mug red mug, Red"), (2, 1, ""), (3, 2, "x mug"), (None, 1, "blue mug")]
    counted = matching._term_counts(spark.createDataFrame(texts, "doc long, members long, text string"), "text")
    plan = counted._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("regexp_extract_all") == 1
    assert sorted((r.doc or 0, r.members, r.term, r.tf) for r in counted.collect()) == [
        (0, 1, "blue", 1), (0, 1, "blue mug", 1), (0, 1, "mug", 1),
        (1, 1, "mug", 2), (1, 1, "mug red", 2), (1, 1, "red", 3), (1, 1, "red mug", 2), (3, 2, "mug", 1),
    ]
