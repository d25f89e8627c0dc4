"""Product matching: exact codes, edit similarity, TF-IDF, vectors and rank.

Product inputs have ``idx`` (0-based rank), ``product_id``, ``product_name`` and
``category``. Match results have ``idx``, ``match_idx`` and ``score``.
"""

from __future__ import annotations

import math
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillframe.functions.lengths import hashed, squared_lengths
from tillframe.functions.ordering import with_position, with_scalars
from tillframe.functions.skew import join_keyed
from tillframe.functions.text import char_ngrams, is_marked, marks, sorted_tokens, substrings, token_terms, word_tokens
from tillframe.functions.vectors import BLOCK_ROWS, nearest
from tillframe.operators.cleaning import normalize_code
from tillframe.sources.storage import materialize

# Default thresholds and the number of review codes.
FUZZY_THRESHOLD = 80.0
TFIDF_THRESHOLD = 0.25
SEMANTIC_THRESHOLD = 0.10
REVIEW_CODES = 1000
AUTO_SCORE, REVIEW_SCORE = 0.70, 0.50
FEW_TOUCHED = 8  # reviews with a word of a name are few if they are less than one in 8

_EPS = 1e-9
_BIGRAM_FLOOR = 75.0


def review_code(idx: Column) -> Column:
    return F.format_string("REV_%04d", F.pmod(idx, F.lit(REVIEW_CODES)) + 1)


def hard_match(products: DataFrame, rows: int | None = None) -> DataFrame:
    """Products whose normalised code was already seen at a better rank; score 1."""
    coded = products.select("idx", normalize_code(F.col("product_id")).alias("code"))
    first = coded.groupBy("code").agg(F.min("idx").alias("match_idx"))
    joined = join_keyed(coded, first, "code", "inner", keyed_rows=products.count() if rows is None else rows)
    return joined.where(F.col("match_idx") != F.col("idx")).select("idx", "match_idx", F.lit(1.0).alias("score"))


# --- edit similarity -------------------------------------------------------


def _lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, one bit per character of ``a``."""
    masks: dict[str, int] = {}
    for i, char in enumerate(a):
        masks[char] = masks.get(char, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row = full
    for char in b:
        hit = row & masks.get(char, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def _edit_ratios(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([200.0 * _lcs(x, y) / (len(x) + len(y)) if x or y else 100.0 for x, y in zip(a, b)])


def edit_ratio(a: str, b: str) -> Column:
    """Similarity from 0 to 100: twice the common subsequence over both lengths."""
    return F.pandas_udf(_edit_ratios, "double")(a, b)


def _numbered(tokens: Column) -> Column:
    """Tokens with their repeat number, so that repeats count as separate tokens."""
    return F.transform(
        tokens,
        lambda t, i: F.concat(t, F.lit("#"), F.size(F.filter(F.slice(tokens, F.lit(1), i + 1), lambda x: x == t))),
    )


def _edit_candidates(keys: DataFrame, threshold: float) -> DataFrame:
    """Pairs (rep, other) that can reach ``threshold``; misses none.

    A pair at the threshold shares at least ``need`` tokens (two-letter pieces, or
    letters for low thresholds). With tokens ordered from rare to common, the
    first shared one leaves enough tokens on both sides to reach ``need``.
    """
    share = threshold / 200.0
    size = 2 if threshold >= _BIGRAM_FLOOR else 1

    def need(total: Column) -> Column:
        pieces = total * (3 * share - 1) - 1 if size == 2 else total * share
        return F.greatest(F.ceil(pieces - _EPS), F.lit(1))

    measured = keys.withColumn("len", F.length("key"))
    tokens = measured.select("rep", "single", "len", F.explode(_numbered(substrings(F.col("key"), size))).alias("tok"))
    common = tokens.groupBy("tok").agg(F.count("*").alias("df"))
    ordered = Window.partitionBy("rep").orderBy("df", "tok")
    # The shortest partner a string of this length can have sets its largest prefix.
    smallest = F.col("len") + F.ceil(F.col("len") * share / (1 - share) - _EPS)
    postings = (
        tokens.join(common, "tok")
        .withColumn("pos", F.row_number().over(ordered))
        .withColumn("left_over", F.col("len") - (size - 1) - F.col("pos") + 1)
        .where(F.col("left_over") >= need(smallest))
    )
    a = postings.where("single").select("tok", "rep", F.col("len").alias("la"), F.col("left_over").alias("oa"))
    b = postings.select("tok", F.col("rep").alias("other"), F.col("len").alias("lb"), F.col("left_over").alias("ob"))
    total = F.col("la") + F.col("lb")
    in_reach = (F.least("la", "lb") >= total * share - _EPS) & (F.col("rep") != F.col("other"))
    pairs = (
        a.join(b, "tok")
        .where(in_reach & (F.least("oa", "ob") >= need(total)))
        .select("rep", "other")
        .distinct()
    )
    if size == 1:
        return pairs
    # Very short pairs need not share a two-letter piece: they share a letter.
    short = math.floor(1 / (3 * share - 1) + _EPS)
    letters = measured.where(F.col("len") <= short).select(
        "rep", "single", "len", F.explode(F.array_distinct(substrings(F.col("key"), 1))).alias("tok")
    )
    c = letters.where("single").select("tok", "rep", F.col("len").alias("la"))
    d = letters.select("tok", F.col("rep").alias("other"), F.col("len").alias("lb"))
    close = c.join(d, "tok").where(in_reach & (total <= short)).select("rep", "other")
    return pairs.unionByName(close).distinct()


def fuzzy_match(products: DataFrame, threshold: float = FUZZY_THRESHOLD) -> DataFrame:
    """The most similar other name by token-sort ratio, kept if it has a better rank.

    Names with the same words are matched by grouping; only names without such a
    twin are compared with others, through shared rare pieces.
    """
    keyed = products.select("idx", sorted_tokens(F.coalesce("product_name", F.lit(""))).alias("key"))
    keys = keyed.groupBy("key").agg(F.min("idx").alias("rep"), (F.count("*") == 1).alias("single"))
    keys = materialize(keys, "name-keys")
    twins = join_keyed(keyed, keys.select("key", "rep"), "key", "inner").where(F.col("idx") != F.col("rep"))
    same = twins.select("idx", F.col("rep").alias("match_idx"), F.lit(1.0).alias("score"))
    left = keys.select("rep", F.col("key").alias("a"))
    right = keys.select(F.col("rep").alias("other"), F.col("key").alias("b"))
    scored = (
        _edit_candidates(keys, threshold)
        .join(left, "rep")
        .join(right, "other")
        .withColumn("ratio", edit_ratio("a", "b"))
        .where(F.col("ratio") >= threshold - _EPS)
    )
    best = scored.groupBy("rep").agg(F.max(F.struct(F.round("ratio", 9).alias("ratio"), (-F.col("other")).alias("neg"))).alias("m"))
    near = best.select(
        F.col("rep").alias("idx"),
        (-F.col("m.neg")).alias("match_idx"),
        F.round(F.col("m.ratio") / 100, 4).alias("score"),
    ).where(F.col("match_idx") < F.col("idx"))
    return same.unionByName(near)


# --- TF-IDF on character n-grams ------------------------------------------


def _named_profiles(names: DataFrame) -> DataFrame:
    """(name, first, members, key, terms) of the distinct names that have n-grams.

    ``terms`` are the n-grams with their counts over the greatest common divisor
    of the counts: names whose counts are in the same proportions have the same
    profile, and their cosine is 1. ``key`` is a 128-bit hash of it.
    """
    distinct = names.groupBy(F.coalesce("name", F.lit("")).alias("name")).agg(
        F.min("idx").alias("first"), F.count("*").alias("members")
    )
    grams = distinct.select("name", "first", "members", F.explode(char_ngrams(F.col("name"))).alias("gram"))
    counted = grams.groupBy("name", "first", "members", "gram").agg(F.count("*").alias("tf"))
    listed = counted.groupBy("name", "first", "members").agg(
        F.array_sort(F.collect_list(F.struct("gram", "tf"))).alias("counts"), F.min("tf").alias("least")
    )
    divides = F.filter(F.sequence(F.lit(1), F.col("least")), lambda d: F.forall("counts", lambda t: t["tf"] % d == 0))
    divided = listed.withColumn("shared", F.array_max(divides))
    terms = F.transform("counts", lambda t: F.struct(t["gram"].alias("gram"), (t["tf"] / F.col("shared")).cast("int").alias("tf")))
    shaped = divided.withColumn("terms", terms)
    return shaped.select("name", "first", "members", F.md5(F.to_json("terms")).alias("key"), "terms")


def _profiles(named: DataFrame) -> DataFrame:
    """Distinct profiles: key, first ``idx``, number of names, grams with counts."""
    return named.groupBy("key").agg(
        F.min("first").alias("rep"), F.sum("members").alias("members"), F.any_value("terms").alias("terms")
    )


def _postings(profiles: DataFrame, idf: DataFrame) -> DataFrame:
    """Unit weights per (rep, gram) and ``rest``, the squared length from that gram on.

    Grams run from rare to common, so ``rest`` drops slowly over the common ones.
    """
    terms = profiles.select("rep", F.explode("terms").alias("t")).select("rep", "t.gram", "t.tf")
    weighted = terms.join(idf, "gram").withColumn("w", F.col("tf") * F.col("idf"))
    whole = Window.partitionBy("rep")
    onward = whole.orderBy("df", "gram").rowsBetween(0, Window.unboundedFollowing)
    return weighted.withColumn("u", F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(whole))).select(
        "rep", "gram", "u", F.sum(F.col("u") * F.col("u")).over(onward).alias("rest")
    )


def _vectors(postings: DataFrame) -> DataFrame:
    return postings.groupBy("rep").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("gram", "u")))).alias("vec")
    )


def _best_cosine(left: DataFrame, right: DataFrame, threshold: float, skip_same: bool) -> DataFrame:
    """Per left profile the best right profile with cosine at or above ``threshold``.

    The first shared gram of a pair bounds its cosine by the lengths of both
    vectors from there on, so pairs below the bound are dropped in the join.
    """
    a = left.select("gram", F.col("rep").alias("a"), F.col("rest").alias("ra"))
    b = right.select("gram", F.col("rep").alias("b"), F.col("rest").alias("rb"))
    floor = (threshold - 1e-6) ** 2
    a, b = a.where(F.col("ra") >= floor - _EPS), b.where(F.col("rb") >= floor - _EPS)
    reachable = F.col("ra") * F.col("rb") >= floor - _EPS
    if skip_same:
        reachable = reachable & (F.col("a") != F.col("b"))
    pairs = a.join(b, "gram").where(reachable).select("a", "b").distinct()
    scored = pairs.join(_vectors(left).select(F.col("rep").alias("a"), F.col("vec").alias("va")), "a").join(
        _vectors(right).select(F.col("rep").alias("b"), F.col("vec").alias("vb")), "b"
    )
    cosine = F.aggregate(
        F.map_entries("va"),
        F.lit(0.0),
        lambda s, e: s + e["value"] * F.coalesce(F.try_element_at("vb", e["key"]), F.lit(0.0)),
    )
    best = F.max(F.struct(F.round("cos", 6).alias("cos"), (-F.col("b")).alias("neg"), F.col("cos").alias("raw")))
    kept = scored.withColumn("cos", cosine).where(F.round("cos", 6) >= threshold).groupBy("a").agg(best.alias("m"))
    return kept.select("a", (-F.col("m.neg")).alias("b"), F.col("m.raw").alias("cos"))


def _idf(profiles: DataFrame, total: DataFrame) -> DataFrame:
    """Document frequency and smoothed idf; profiles count once per member, of ``total`` (n) names."""
    df = (
        profiles.select("members", F.explode("terms.gram").alias("gram"))
        .groupBy("gram")
        .agg(F.sum("members").alias("df"))
    )
    return with_scalars(df, total).select(
        "gram", "df", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf")
    )


def tfidf_match(
    left: DataFrame,
    right: DataFrame | None = None,
    threshold: float = TFIDF_THRESHOLD,
    include_self: bool = True,
) -> DataFrame:
    """Best right name per left name by TF-IDF cosine over padded character n-grams.

    Inputs have ``idx`` and ``name``. Without ``right`` the names are compared
    with themselves and each counts twice in the frequencies; with
    ``include_self`` the winner is then the first name whose cosine rounds to 1.
    """
    total = left.agg((F.count("*") * (2 if right is None else 1)).alias("n"))  # also names without any n-gram
    named = materialize(_named_profiles(left), "named-profiles")
    own = materialize(_profiles(named), "profiles")
    keyed = named.select("name", "key").join(own.select("key", "rep", F.col("members").alias("size")), "key")
    members = join_keyed(
        left.select("idx", F.coalesce("name", F.lit("")).alias("name")), keyed.select("name", "rep", "size"), "name", "inner"
    ).select("idx", "rep", "size")
    if right is None and include_self:
        # A name is always its own best match at 1; names that round to 1 tie, and the first of them wins.
        doubled = own.withColumn("members", F.col("members") * 2)
        posts = materialize(_postings(doubled, _idf(doubled, total)), "postings")
        found = _best_cosine(posts, posts, max(threshold, 1.0), skip_same=False).withColumnRenamed("a", "rep")
        joined = join_keyed(members, found, "rep", "inner")
        return joined.select("idx", F.col("b").alias("match_idx"), F.round("cos", 4).alias("score"))
    if right is None:
        doubled = own.withColumn("members", F.col("members") * 2)
        posts = materialize(_postings(doubled, _idf(doubled, total)), "postings")
        twin = members.where(F.col("size") > 1)
        second = twin.where(F.col("idx") != F.col("rep")).groupBy("rep").agg(F.min("idx").alias("second"))
        twins = join_keyed(twin, second, "rep", "inner").select(
            "idx",
            F.when(F.col("idx") == F.col("rep"), F.col("second")).otherwise(F.col("rep")).alias("match_idx"),
            F.lit(1.0).alias("score"),
        )
        lone = own.where(F.col("members") == 1).select("rep")
        found = _best_cosine(posts.join(lone, "rep", "left_semi"), posts, threshold, skip_same=True)
        near = found.select(
            F.col("a").alias("idx"), F.col("b").alias("match_idx"), F.round("cos", 4).alias("score")
        )
        return twins.unionByName(near)
    other = materialize(_profiles(_named_profiles(right)), "profiles")
    both = with_scalars(total, right.agg(F.count("*").alias("m"))).select((F.col("n") + F.col("m")).alias("n"))
    idf = _idf(own.unionByName(other), both)
    found = _best_cosine(_postings(own, idf), _postings(other, idf), threshold, skip_same=False)
    joined = join_keyed(members, found.withColumnRenamed("a", "rep"), "rep", "inner")
    return joined.select("idx", F.col("b").alias("match_idx"), F.round("cos", 4).alias("score"))


# --- mapping ---------------------------------------------------------------


def rank_match(products: DataFrame) -> DataFrame:
    """Each product with the review code of its own rank; score 0."""
    return products.select("idx", "product_id", review_code(F.col("idx")).alias("review_code"), F.lit(0.0).alias("score"))


def golden_records(
    products: DataFrame,
    strategy: str = "semantic",
    use_fuzzy: bool = True,
    use_tfidf: bool = True,
    fuzzy_threshold: float = FUZZY_THRESHOLD,
    tfidf_threshold: float = TFIDF_THRESHOLD,
) -> DataFrame:
    """The product mapping: the first of hard, fuzzy, tfidf and rank that applies.

    The review code is that of the matched twin's rank. ``strategy="poc"`` uses
    the rank alone.
    """
    if strategy not in ("poc", "fuzzy", "semantic"):
        raise ValueError(f"unknown strategy: {strategy}")
    steps: list[tuple[str, DataFrame]] = []
    if strategy != "poc":
        steps.append(("hard", hard_match(products)))
        if use_fuzzy:
            steps.append(("fuzzy", fuzzy_match(products, fuzzy_threshold)))
        if use_tfidf:
            names = products.select("idx", F.col("product_name").alias("name"))
            steps.append(("tfidf", tfidf_match(names, threshold=tfidf_threshold)))
    rows = products
    for name, found in steps:
        renamed = found.select("idx", F.struct(F.col("match_idx").alias("idx"), "score", F.lit(name).alias("how")).alias(name))
        rows = rows.join(renamed, "idx", "left")
    fallback = F.struct(F.col("idx").alias("idx"), F.lit(0.0).alias("score"), F.lit("rank").alias("how"))
    return rows.withColumn("m", F.coalesce(*[F.col(n) for n, _ in steps], fallback)).select(
        (F.col("idx") + 1).alias("mapping_id"),
        "product_id",
        "product_name",
        review_code(F.col("m.idx")).alias("review_code"),
        "category",
        F.col("product_name").alias("golden_name"),
        F.round("m.score", 4).alias("match_score"),
        F.col("m.how").alias("match_strategy"),
    )


def match_quality(mapping: DataFrame) -> DataFrame:
    """Mappings per strategy with their share and mean score."""
    total = mapping.agg(F.count("*").alias("n"))
    per = mapping.groupBy("match_strategy").agg(F.count("*").alias("mappings"), F.avg("match_score").alias("s"))
    return with_scalars(per, total).select(
        "match_strategy",
        "mappings",
        F.round(F.col("mappings") * F.lit(100).cast("decimal(5,0)") / F.col("n"), 1).cast("double").alias("share_pct"),
        F.round("s", 4).alias("mean_score"),
    )


def hybrid_match(products: DataFrame, threshold: float = TFIDF_THRESHOLD) -> DataFrame:
    """Best other name scored 0.6 cosine + 0.4 edit similarity, with its handling."""
    names = products.select("idx", F.col("product_name").alias("name"))
    found = tfidf_match(names, threshold=threshold, include_self=False)
    a = names.withColumnRenamed("name", "name_a")
    b = names.select(F.col("idx").alias("match_idx"), F.col("name").alias("name_b"))
    edit = 1 - F.levenshtein("name_a", "name_b") / F.greatest(F.length("name_a"), F.length("name_b"), F.lit(1))
    score = F.round(0.6 * F.col("score") + 0.4 * edit, 4)
    route = (
        F.when(F.col("hybrid_score") >= AUTO_SCORE, "auto")
        .when(F.col("hybrid_score") >= REVIEW_SCORE, "manual_review")
        .otherwise("quarantine")
    )
    return (
        found.join(a, "idx")
        .join(b, "match_idx")
        .withColumn("hybrid_score", score)
        .select("idx", "match_idx", F.col("score").alias("cosine"), "hybrid_score", route.alias("route"))
    )


HISTORY_VALUES = ("review_code", "golden_name", "match_score", "match_strategy")


def update_history(history: DataFrame, mapping: DataFrame, as_of: Column) -> DataFrame:
    """Close changed or vanished mappings and open the new ones.

    ``history`` has ``product_id``, the mapping values, ``valid_from`` and
    ``valid_to``; rows with ``valid_to`` set stay as they are.
    """
    closed = history.where(F.col("valid_to").isNotNull())
    current = history.where(F.col("valid_to").isNull())
    new = mapping.select("product_id", F.struct(*HISTORY_VALUES).alias("new"))
    both = current.withColumn("old", F.struct(*HISTORY_VALUES)).join(new, "product_id", "full_outer")
    same = F.col("old").isNotNull() & F.col("new").isNotNull() & (F.col("old") == F.col("new"))
    kept = both.where(F.col("old").isNotNull()).select(
        "product_id", "old.*", "valid_from", F.when(same, F.lit(None)).otherwise(as_of).cast("timestamp_ntz").alias("valid_to")
    )
    opened = both.where(F.col("new").isNotNull() & ~F.coalesce(same, F.lit(False))).select(
        "product_id",
        "new.*",
        as_of.cast("timestamp_ntz").alias("valid_from"),
        F.lit(None).cast("timestamp_ntz").alias("valid_to"),
    )
    return closed.select(kept.columns).unionByName(kept).unionByName(opened)


def mapping_as_of(facts: DataFrame, history: DataFrame, at: str) -> DataFrame:
    """``facts`` with the mapping values of their product that were valid at their time ``at``; null if none was.

    A mapping is valid from ``valid_from`` on and before ``valid_to``; intervals of
    a product do not overlap, so no row is repeated.
    """
    valid = history.select(F.col("product_id").alias("_product"), *HISTORY_VALUES, F.col("valid_from").alias("_from"), F.col("valid_to").alias("_to"))
    open_end = F.col("_to").isNull() | (F.col(at) < F.col("_to"))
    hit = (F.col("product_id") == F.col("_product")) & (F.col("_from") <= F.col(at)) & open_end
    return facts.join(valid, hit, "left").drop("_product", "_from", "_to")


# --- attaching reviews -----------------------------------------------------


def attach_reviews_rr(reviews: DataFrame, mapping: DataFrame) -> DataFrame:
    """Give review i the code of mapping row i modulo the number of rows.

    ``reviews`` has ``review_key``; the result has ``review_id`` (1-based) too.
    """
    numbered = with_position(reviews, ["review_key"], "place")
    count = mapping.agg(F.count("*").alias("n"))
    slot = with_scalars(numbered, count).withColumn("mapping_id", F.col("place") % F.col("n") + 1).drop("n")
    codes = mapping.select("mapping_id", "review_code")
    return slot.join(codes, "mapping_id").withColumn("review_id", F.col("place") + 1).drop("mapping_id", "place")


def semantic_assign(
    reviews: DataFrame, products: DataFrame, threshold: float = SEMANTIC_THRESHOLD, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """The closest product of each review vector; the commonest one below the threshold.

    Both inputs have ``id`` and ``vec``. Without any review at the threshold the
    product is null, and the caller goes on with the word-based way.
    """
    found = materialize(nearest(reviews, products, block_rows), "nearest")
    sure = found.where(F.col("score") >= threshold).groupBy("target_id").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    commonest = sure.agg(F.max(F.struct("n", (-F.col("first")).alias("f"), "target_id"))["target_id"].alias("common"))
    return with_scalars(found, commonest).select(
        F.col("id").alias("review_key"),
        F.when(F.col("score") >= threshold, F.col("target_id")).otherwise(F.col("common")).alias("product_idx"),
        (F.col("score") >= threshold).alias("confident"),
        "score",
    )


def _tokenised(docs: DataFrame, text: str) -> DataFrame:
    """``docs`` with the words of its whole texts, cut once per text, in place of the text."""
    return docs.select(*[c for c in docs.columns if c != text], word_tokens(F.coalesce(F.col(text), F.lit(""))).alias("tokens"))


def _each(df: DataFrame, array: Column, name: str) -> DataFrame:
    """``df`` without ``tokens`` and with a row per element.

    Not a plain ``explode``: from that, a filter on the array would be put
    before all joins, and every text would be cut once more.
    """
    kept = [c for c in df.columns if c not in ("tokens", "terms", "starts")]
    return df.select(*kept, F.explode_outer(array).alias(name)).where(F.col(name).isNotNull())


def _term_counts(docs: DataFrame, text: str) -> DataFrame:
    """(doc, members, term, tf) of the whole texts of ``docs`` (doc, members, text): a row per text and term."""
    return _counted(_tokenised(docs, text).select("doc", "members", token_terms(F.col("tokens")).alias("terms")))


def _counted(listed: DataFrame) -> DataFrame:
    """(doc, members, term, tf) of ``listed`` (doc, members, terms): a row per text and term.

    The sorted terms of a text are counted by the places where they change, so
    no term leaves its task.
    """
    listed = listed.select("doc", "members", F.sort_array("terms").alias("terms"))
    places = F.when(F.size("terms") > 0, F.sequence(F.lit(0), F.size("terms") - 1))
    starts = F.filter(places, lambda i: (i == 0) | (F.get("terms", i) != F.get("terms", F.greatest(i - 1, F.lit(0)))))
    begun = listed.select("doc", "members", "terms", starts.alias("starts"))
    counted = F.transform(
        "starts",
        lambda i, k: F.struct(F.get("terms", i).alias("term"), (F.coalesce(F.get("starts", k + 1), F.size("terms")) - i).cast("long").alias("tf")),
    )
    return _each(begun, counted, "t").select("doc", "members", "t.term", "t.tf")


def _marked_terms(texts: DataFrame, words_of: DataFrame) -> DataFrame:
    """(doc, members, terms): terms made of words that are certainly or possibly among the words of ``words_of`` (term)."""
    marked = with_scalars(_tokenised(texts, "review_text"), marks(words_of.where(~F.contains("term", F.lit(" "))), "term"))
    # Other words leave their places empty, so no pair is made of them.
    kept = marked.select("doc", "members", F.transform("tokens", lambda t: F.when(is_marked(t), t)).alias("tokens"))
    return kept.select("doc", "members", F.array_compact(token_terms(F.col("tokens"))).alias("terms"))


def attach_reviews_tfidf(reviews: DataFrame, mapping: DataFrame, max_features: int = 0) -> DataFrame:
    """The product whose name is closest to the review text, by words and word pairs.

    ``reviews`` has ``review_key`` and ``review_text``. The vocabulary is all
    terms of names and reviews, or the ``max_features`` commonest of them. A
    review sharing no term with any name gets the first product.

    Only terms of names get a row per review that holds them. All other terms count
    in the lengths of reviews alone, and only reviews that hold a word of a name
    have a score; their lengths are summed over packed terms.
    """
    names = mapping.select((F.col("mapping_id") - 1).alias("idx"), F.col("golden_name").alias("name"))
    distinct = materialize(names.groupBy("name").agg(F.min("idx").alias("doc"), F.count("*").alias("members")), "names")
    name_terms = _term_counts(distinct, "name").groupBy("doc", "members", "term").agg(F.sum("tf").alias("tf"))
    name_terms = materialize(name_terms, "name-terms")
    products = mapping.count()
    size = reviews.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("review_text")), F.lit(0)).alias("chars")).first()
    total = size.n + products
    weight = F.col("tf") * (F.log((1 + F.lit(total)) / (1 + F.col("df"))) + 1)
    texts = reviews.select(F.col("review_key").alias("doc"), F.lit(1).cast("long").alias("members"), "review_text")
    if max_features:
        review_terms = _term_counts(texts, "review_text")
        every = name_terms.unionByName(review_terms).groupBy("term")
        uses = every.agg(F.sum(F.col("members") * F.col("tf")).alias("uses"), F.sum("members").alias("df"))
        known = materialize(uses.orderBy(F.desc("uses"), "term").limit(max_features).select("term", "df"), "vocabulary")
        # A review of several rows counts as one text; its terms are summed.
        weighed = review_terms.join(known, "term").groupBy("doc", "term", "df").agg(F.sum("tf").alias("tf")).select("doc", "term", weight.alias("w"))
        weighed = materialize(weighed, "review-weights")
        lengths = weighed.groupBy("doc").agg(F.sum(F.col("w") * F.col("w")).alias("ww"))
    else:
        named = _counted(_marked_terms(texts, name_terms)).join(name_terms.select("term").distinct(), "term", "left_semi")
        named = materialize(named.select("doc", "members", "term", "tf"), "named-terms")
        both = name_terms.select("term", "members").unionByName(named.select("term", "members"))
        known = materialize(both.groupBy("term").agg(F.sum("members").alias("df")), "vocabulary")
        weighed = named.groupBy("doc", "term").agg(F.sum("tf").alias("tf")).join(known, "term").select("doc", "term", weight.alias("w"))
        lengths = materialize(_squared_lengths(texts, name_terms, named, size.n, total, size.chars), "review-lengths")
    of_names = name_terms.join(known, "term").select(F.col("doc").alias("idx"), "term", weight.alias("w"))
    name_lengths = of_names.groupBy("idx").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("name_length"))
    units = of_names.join(name_lengths, "idx").select("idx", "term", (F.col("w") / F.col("name_length")).alias("u"))
    shared = weighed.join(units, "term")
    dots = shared.groupBy("doc", "idx").agg(F.sum(F.col("w") * F.col("u")).alias("dot"))
    scored = dots.join(lengths, "doc").select("doc", "idx", F.round(F.col("dot") / F.sqrt("ww"), 6).alias("score"))
    best = scored.where("score > 0").groupBy("doc").agg(F.max(F.struct("score", (-F.col("idx")).alias("neg"))).alias("m"))
    assigned = best.select(
        F.col("doc").alias("review_key"), (-F.col("m.neg")).alias("product_idx"), F.col("m.score").alias("score")
    )
    codes = mapping.select((F.col("mapping_id") - 1).alias("product_idx"), "review_code")
    joined = reviews.select("review_key").join(assigned, "review_key", "left").select(
        "review_key",
        F.coalesce("product_idx", F.lit(0)).alias("product_idx"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )
    return join_keyed(joined, codes, "product_idx", "left", keyed_rows=products)


def _squared_lengths(texts: DataFrame, name_terms: DataFrame, named: DataFrame, rows: int, total: int, chars: int) -> DataFrame:
    """(doc, ww): squared lengths of at least those of ``texts`` that hold a term of a name, which ``named`` lists.

    Where few texts do, only those are packed, and of the others the terms that
    these need are counted. Else all are packed, and no text is moved.
    """
    members = [name_terms.select("term", "members")]
    touched = materialize(named.select(F.col("doc").alias("_doc")).distinct(), "named-reviews")
    if touched.count() * FEW_TOUCHED < rows:
        same = F.col("doc").eqNullSafe(F.col("_doc"))
        others, texts = texts.join(touched, same, "left_anti"), texts.join(touched, same, "left_semi")
        members += _uses_elsewhere(others, _term_counts(texts, "review_text"), touched)
    elsewhere = reduce(DataFrame.unionByName, members).select(hashed(F.split("term", " ")).alias("tokens"), "members")
    keys = texts.groupBy("doc").agg(F.count("*").alias("n"))
    if keys.where("n > 1 AND doc IS NOT NULL").isEmpty():  # no length of a review without a key is used
        # By doc, so that a task that runs again packs the same batches.
        cut = _tokenised(texts.select("doc", "review_text").sortWithinPartitions("doc"), "review_text")
        listed = cut.select("doc", F.array(hashed(F.col("tokens"))).alias("texts"))
    else:
        # The texts of a key meet; their terms are counted together.
        grouped = texts.groupBy("doc").agg(F.collect_list("review_text").alias("texts")).sortWithinPartitions("doc")
        listed = grouped.select("doc", F.transform("texts", lambda t: hashed(word_tokens(t))).alias("texts"))
    return squared_lengths(listed, elsewhere, total, chars)


def _uses_elsewhere(texts: DataFrame, review_terms: DataFrame, touched: DataFrame) -> list[DataFrame]:
    """How many of the other ``texts`` hold each of ``review_terms``; nothing if one side is empty.

    The words of a needed pair are needed as well, so only needed words are put together.
    """
    if touched.isEmpty() or texts.isEmpty():
        return []
    needed = materialize(review_terms.select("term").distinct(), "needed-terms")
    held = _each(_marked_terms(texts, needed).select(F.array_distinct("terms").alias("tokens")), F.col("tokens"), "term")
    return [held.join(needed, "term", "left_semi").groupBy("term").agg(F.count("*").alias("members"))]
