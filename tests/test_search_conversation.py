from __future__ import annotations

import os
import tracemalloc
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from tillframe.functions.rules import route_analysis, route_question
from tillframe.functions.text import char_ngrams, match_keywords, name_keywords, sorted_tokens, word_terms
from tillframe.functions.vectors import nearest, top_k
from tillframe.operators import conversation, reports, search, vector_index


def one(spark, text, build):
    return spark.createDataFrame([(text,)], "t string").select(build(F.col("t")).alias("x")).first().x


def test_char_ngrams(spark):
    assert one(spark, "Ab  c", char_ngrams) == [" a", "ab", "b ", " ab", "ab ", " ab ", " c", "c ", " c "]
    assert one(spark, "", char_ngrams) == []


def test_word_terms(spark):
    assert one(spark, "The café, a Mug_2!", word_terms) == ["the", "café", "mug_2", "the café", "café mug_2"]
    assert one(spark, "x", word_terms) == []


def test_names(spark):
    assert one(spark, "b  a c", sorted_tokens) == "a b c"
    assert one(spark, "THE BIG JOE'S LAMP and SHADE", name_keywords) == ["joes", "lamp", "shade"]


def test_keyword_search_both_ways(spark, rows):
    texts = [(1, "Big LAMPS here"), (2, "a lamp"), (3, None), (4, "é bird"), (5, "x"), (6, "lam p"), (7, "w" * 3000 + "lamp" + "v" * 3000), (8, "big  lamp"), (9, "Big lamp x")]
    words = ["lamp", "BIRD", "x", "é", "amps", "lamp", "", None, "g lamp", " ", "  ", "big lamp"]
    got = rows(match_keywords(spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame([(w,) for w in words], "keyword string")))
    want = sorted({(i, w.lower()) for i, t in texts for w in words if w and t and w.lower() in t.lower()})
    assert got == sorted(want, key=repr)


def test_keyword_search_runs_on_the_engine(spark):
    texts = spark.createDataFrame([(1, "a lamp")], "id long, text string")
    plan = match_keywords(texts, spark.createDataFrame([("lamp",)], "keyword string"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan


def test_name_lookup(spark, rows):
    names = spark.createDataFrame([("RED LAMP",), ("RED LAMP",), ("LAMPSHADE",), ("MUG",)], "product_name string")
    terms = spark.createDataFrame([("lamp",), ("MUG",), ("%",)], "keyword string")
    assert rows(reports.name_lookup(names, terms)) == [("lamp", "LAMPSHADE", 1), ("lamp", "RED LAMP", 2), ("mug", "MUG", 1)]


def vectors(spark, count=200, dims=8, seed=0):
    rng = np.random.default_rng(seed)
    data = rng.normal(size=(count, dims)).astype(np.float32)
    data[3] = 0  # a zero vector is similar to nothing
    return data, spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(data)], "id long, vec array<float>")


@pytest.mark.parametrize("block", [50_000, 30])
def test_top_k_equals_all_pairs(spark, block):
    data, corpus = vectors(spark)
    queries = corpus.where("id < 5 AND id <> 3")
    got = {}
    for r in top_k(corpus.repartition(6), queries, 4, block).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.id)
    unit = data.astype(float) / np.maximum(np.linalg.norm(data.astype(float), axis=1, keepdims=True), 1e-30)
    for q in (0, 1, 2, 4):
        scores = np.round(unit @ unit[q], 6)
        assert got[q] == sorted(range(len(data)), key=lambda i: (-scores[i], i))[:4]


def test_index_with_all_cells_finds_everything(spark, rows):
    _, corpus = vectors(spark)
    queries = corpus.where("id IN (10, 20, 30)")
    index = vector_index.build_index(corpus, 5, cells=6)
    assert index.codes.groupBy("id").count().where("count <> 2").count() == 0 and index.codes.count() == 2 * corpus.count()
    everything = vector_index.search_index(index._replace(refined=200), queries, 5, probes=index.cells)
    assert rows(everything, "query_id", "id", "rank") == rows(top_k(corpus, queries, 5), "query_id", "id", "rank")
    assert 0 < vector_index.share_read(index, queries) <= 1


def test_index_blocks_and_crowds(spark, rows, monkeypatch):
    """Large cells are scored in blocks, many queries of a cell in several tasks: the same hits."""
    _, corpus = vectors(spark)
    queries = corpus.where("id % 3 = 0 AND id <> 3")
    index = vector_index.build_index(corpus, 5, cells=4)
    whole = rows(vector_index.search_index(index._replace(refined=200), queries, 5))
    monkeypatch.setattr(vector_index, "BLOCK", 7)
    monkeypatch.setattr(vector_index, "TOGETHER", 5)
    small = vector_index.build_index(corpus, 5, cells=4)
    assert small.blocks.agg(F.max("blocks")).first()[0] > 5
    assert rows(vector_index.search_index(small._replace(refined=200, probes=index.probes), queries, 5)) == whole


def test_index_of_few_or_equal_rows(spark, rows):
    few = spark.createDataFrame([(k, [1.0, 0.0, float(k == 2)]) for k in range(3)] + [(9, [0.0] * 3)], "id long, vec array<double>")
    index = vector_index.build_index(few, 2)
    got = rows(vector_index.search_index(index, few.where("id = 0"), 2), "query_id", "id", "score")
    assert got == [(0, 0, 1.0), (0, 1, 1.0)]


def test_codes_are_the_closest_values():
    data = np.random.default_rng(1).normal(size=(50, 10))
    books = [vector_index.lloyd(data[:, s], 8) for s in vector_index.stretches(10)]
    codes = vector_index.encoded(data, books)
    for s, book, own in zip(vector_index.stretches(10), books, codes.T):
        gaps = ((data[:, None, s] - book) ** 2).sum(2)
        assert np.allclose(gaps[np.arange(50), own], gaps.min(1))


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.01", "/root/testdata/sf0.1"])
def test_recall_on_the_given_vectors(spark, folder):
    if not os.path.isdir(folder):
        pytest.skip("test data not present")
    corpus = spark.read.parquet(f"{folder}/embeddings.parquet").selectExpr("vec_id AS id", "embedding AS vec")
    queries = corpus.where("id % 50 = 0")
    found = vector_index.search_index(vector_index.build_index(corpus, 5), queries, 5)
    recall = search.search_recall(top_k(corpus, queries, 5), found).agg(F.sum("found") / F.sum("wanted")).first()[0]
    assert recall >= 0.9


@pytest.mark.parametrize("block", [4096, 7])
def test_nearest_equals_all_pairs(spark, block):
    data, corpus = vectors(spark, 60)
    targets = corpus.where("id < 25")
    unit = data.astype(float) / np.maximum(np.linalg.norm(data.astype(float), axis=1, keepdims=True), 1e-30)
    scores = np.round(unit @ unit[:25].T, 6)
    got = {r.id: (r.target_id, r.score) for r in nearest(corpus, targets, block).collect()}
    assert got == {i: (int(scores[i].argmax()), scores[i].max()) for i in range(60)}
    none = nearest(corpus, targets.where("id < 0")).collect()
    assert len(none) == 60 and all(r.target_id is None for r in none)


def test_vector_search_repeats_a_review_per_product(spark):
    corpus = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.9, 0.1]), (9, [1.0, 0.0])], "id long, vec array<double>")
    reviews = spark.createDataFrame(
        [(1, 11, "R1", "4.0", "positive"), (2, 12, "R9", "1.0", "negative")], "review_id long, review_key long, review_code string, r string, sentiment string"
    ).withColumn("rating", F.col("r").cast("decimal(3,1)"))
    mapping = spark.createDataFrame([(1, "R1", "MUG"), (2, "R1", "CUP")], "mapping_id long, review_code string, golden_name string")
    queries = spark.createDataFrame([(0, [1.0, 0.0])], "id long, vec array<double>")
    hits = search.vector_search(corpus, queries, reviews, mapping, 3)
    got = [(r.rank, r.review_id, r.product_name) for r in hits.orderBy("rank").collect()]
    assert got == [(1, 1, "MUG"), (2, 1, "CUP"), (3, 2, "R9")]  # vector 9 has no review
    texts = spark.createDataFrame([(11, "x" * 300), (12, "short")], "id long, text string")
    lines = [r.line for r in search.review_snippets(hits, texts).orderBy("rank").collect()]
    assert lines[0] == "1. [MUG] Note:4.0 (positive) — similarité 1.00\n   " + "x" * 200 + "..."


def test_upsert_adds_and_replaces(spark, rows):
    current = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    updates = spark.createDataFrame([(2, "B"), (3, "c")], "id long, v string")
    assert rows(search.upsert(current, updates, "id")) == [(1, "a"), (2, "B"), (3, "c")]


def test_embedding_upsert_encodes_only_missing_reviews(spark):
    current = spark.createDataFrame([(1, [1.0] * 64)], "id long, vec array<double>")
    reviews = spark.createDataFrame([(1, 10), (2, 20), (3, 30)], "review_id long, review_key long")
    texts = spark.createDataFrame([(10, "a"), (20, "red mug red"), (30, None)], "id long, text string")
    got = {r.id: r for r in search.embedding_upsert(current, reviews, texts).collect()}
    assert {k: r.origin for k, r in got.items()} == {1: "existing", 2: "new", 3: "new"}
    assert np.linalg.norm(got[2].vec) == pytest.approx(1.0, abs=1e-6) and not any(got[3].vec)


MESSAGES = "session_id long, seq long, role string, content string, sent_at timestamp_ntz"


def at(minute):
    return datetime(2024, 1, 1, 12, minute)


def test_sessions(spark):
    df = spark.createDataFrame([(1, i, "user", f"m{i}", at(i)) for i in range(5)] + [(2, 0, "user", "x", at(30))], MESSAGES)
    got = [(r.session_id, r.content) for r in conversation.recent_messages(df, 2).collect()]
    assert got == [(1, "m3"), (1, "m4"), (2, "x")]
    # The session that spoke last comes first, however short it is.
    assert [r.session_id for r in conversation.session_summary(df).collect()] == [2, 1]
    assert conversation.session_summary(df, 1).count() == 1


def test_stored_history(spark, tmp_path):
    path = str(tmp_path / "history")
    names = ["s1", "a/b", "user:1", "x=1", "50%", "..", "../up", "é ü", ""]
    for text in ("hello", "again"):
        batch = spark.createDataFrame([(n, "user", f"{text} {n}") for n in names], "session_id string, role string, content string")
        conversation.append_messages(batch, path)
    assert len(list((tmp_path / "history").iterdir())) <= conversation.BUCKETS + 2
    assert [p.name for p in tmp_path.iterdir()] == ["history"]
    left = list(names)
    for n in names:
        conversation.delete_session(spark, path, n)
        left.remove(n)
        stored = conversation.recent_messages(conversation.read_history(spark, path), 10).collect()
        assert sorted((r.session_id, r.content) for r in stored) == sorted((m, f"{t} {m}") for m in left for t in ("hello", "again"))
    conversation.append_messages(spark.createDataFrame([("s1", "user", "back")], "session_id string, role string, content string"), path)
    assert [r.content for r in conversation.read_history(spark, path).collect()] == ["back"]


@pytest.mark.parametrize(
    ("question", "template"),
    [
        ("Quels produits ont une ALERTE ?", "worst_rated_products"),
        ("Top ventes", "best_sellers"),
        ("Clients rentables et satisfaits", "customer_satisfaction"),
        ("Qui est notre acheteur fidèle", "top_customers"),
        ("la note moyenne", "best_rated_products"),
        ("couverture mdm", "data_quality_summary"),
        ("chiffre d'affaires", "revenue_by_category"),
        ("bonjour", "best_sellers"),
    ],
)
def test_routing(spark, question, template):
    assert one(spark, question, route_question) == template


def test_analysis_routing(spark):
    assert one(spark, "segments et cluster", route_analysis) == "segmentation"
    assert one(spark, "K-means svp", route_analysis) == "clustering"
    assert one(spark, "profil client", route_analysis) == "rfm"
    assert one(spark, "bonjour", route_analysis) is None


@pytest.mark.parametrize(
    ("reply", "sql", "source"),
    [
        ('```json\n{"sql": "SELECT a\nFROM t LIMIT 5", "reasoning": "r"}\n```', "SELECT a\nFROM t LIMIT 5", "written"),
        ('{"sql": "SELECT \\"A\\" FROM t", "answer_template": "x"}', 'SELECT "A" FROM t', "written"),
        ('{"reasoning": "r", "sql": "SELECT 1 FROM t"}', "SELECT 1 FROM t", "written"),
        ('{"sql": "SELECT 1\\nFROM t", "other": "x"', "SELECT 1\nFROM t", "written"),
        ("Voici : select x from t limit 3; merci", "select x from t limit 3", "written"),
        ("{broken json SELECT x FROM t;", "SELECT x FROM t", "written"),
        ("SELECT x FROM t and no end", None, "rules"),
        ('{"sql": "SELECT ...", "reasoning": "r"}', None, "rules"),
        ('{"sql": "SELECT 1", "reasoning": "r"}', None, "rules"),
        ("rien", None, "rules"),
        ("", None, "rules"),
    ],
)
def test_extract_sql(spark, reply, sql, source):
    df = spark.createDataFrame([(1, 1, "bonjour", reply)], "session_id long, seq long, question string, reply string")
    got = conversation.extract_sql(df).first()
    assert (got.sql, got.source, got.template) == (sql, source, None if sql else "best_sellers")


def test_forced_question_overrides_the_written_query(spark):
    df = spark.createDataFrame([(1, 1, "segment rfm", '{"sql": "SELECT 1 FROM t", "reasoning": "r"}')], "session_id long, seq long, question string, reply string")
    got = conversation.extract_sql(df).first()
    assert (got.sql, got.source, got.template) == (None, "forced", "customer_satisfaction")


@pytest.mark.parametrize(
    ("query", "unsafe"), [("select * from t", False), ("DROP TABLE t", True), ("select created_at from t", False), ("x; delete from t", True)]
)
def test_unsafe_queries(spark, query, unsafe):
    df = spark.createDataFrame([(query,)], "q string")
    assert conversation.flag_unsafe_sql(df, "q").first().unsafe is unsafe


def test_read_only_query(spark):
    spark.range(500).createOrReplaceTempView("numbers")
    assert conversation.read_only_query(spark, "SELECT id FROM numbers").count() == 500
    with pytest.warns(UserWarning, match="only 200 rows"):
        assert conversation.read_only_query(spark, "SELECT id FROM numbers", 200).count() == 200
    assert conversation.read_only_query(spark, " with t as (select 1 as x) select x from t", 200).count() == 1
    for query in ("DROP VIEW numbers", "SHOW TABLES", "SELECT 1; DELETE FROM numbers"):
        with pytest.raises(PermissionError):
            conversation.read_only_query(spark, query)


def test_answers(spark):
    spark.range(7).createOrReplaceTempView("numbers")
    templates = {name: lambda name=name: spark.createDataFrame([(name,)], "t string") for name in ("best_sellers", "customer_satisfaction")}
    analyses = {"clustering": lambda df: df.limit(1)}
    ask = lambda q, r: conversation.answer_question(spark, q, r, templates, analyses)
    source, result, extra = ask("bonjour", '{"sql": "SELECT id FROM numbers"}')
    assert (source, result.count(), extra) == ("written", 7, None)
    for reply in ('{"sql": "DROP TABLE x FROM y"}', '{"sql": "SELECT z FROM nowhere"}', "rien", None):
        source, result, _ = ask("bonjour", reply)
        assert (source, result.first().t) == ("rules", "best_sellers")
    source, result, extra = ask("cluster svp", '{"sql": "SELECT id FROM numbers"}')
    assert (source, result.first().t) == ("forced", "customer_satisfaction")


def test_hits_meet_only_the_products_they_can_show(spark, monkeypatch):
    stored = {}
    keep = search.materialize
    monkeypatch.setattr(search, "materialize", lambda df, name, *a, **k: stored.setdefault(name, keep(df, name, *a, **k)))
    vectors = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(1, 5)], "id long, vec array<float>")
    reviews = vectors.select(
        F.col("id").alias("review_id"), F.col("id").alias("review_key"), F.lit("R").alias("review_code"),
        F.lit(4).cast("decimal(3,1)").alias("rating"), F.lit("positive").alias("sentiment"),
    )
    mapping = spark.range(1, 31).select(F.lit("R").alias("review_code"), F.concat(F.lit("n"), "id").alias("golden_name"), F.col("id").alias("mapping_id"))
    found = search.vector_search(vectors, vectors.where("id = 4"), reviews, mapping, 3).orderBy("rank").collect()
    assert [(r.review_id, r.product_name) for r in found] == [(4, "n1"), (4, "n2"), (4, "n3")]
    assert stored["hit-names"].count() == 3


def test_training_books_holds_a_bounded_piece():
    rows = np.random.default_rng(1).normal(size=(60_000, 4))
    tracemalloc.start()
    means = vector_index.lloyd(rows, 256)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert means.shape == (256, 4) and peak < 64 << 20
    assert vector_index.TOGETHER * vector_index.BLOCK <= 1 << 21  # scores of a group that are held at once
