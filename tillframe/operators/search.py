"""Vector search over reviews and upkeep of the vector table."""

from __future__ import annotations

from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillframe.functions.text import words
from tillframe.functions.vectors import dot, top_k
from tillframe.sources.storage import materialize

# Results shown, length of a snippet.
K, SNIPPET = 5, 200


def centroids(vectors: DataFrame, label: str, vec: str) -> DataFrame:
    """The mean vector per label: (id, vec)."""
    means = vectors.groupBy(label).agg(Summarizer.mean(array_to_vector(F.col(vec))).alias("m"))
    return means.select(F.col(label).cast("long").alias("id"), vector_to_array("m").alias("vec"))


def vector_search(
    vectors: DataFrame, queries: DataFrame, reviews: DataFrame, mapping: DataFrame, k: int = K
) -> DataFrame:
    """The ``k`` best hits per query with rating, sentiment and product name.

    ``vectors`` and ``queries`` have ``id`` (review id, query id) and ``vec``. A
    review whose code belongs to several products is a hit per product, as in a
    join before the cut; the ``k`` best hits lie within the ``k`` best reviews.
    """
    indexed = vectors.join(reviews.select(F.col("review_id").alias("id")), "id", "left_semi")
    hits = materialize(top_k(indexed, queries, k).drop("rank"), "hits")  # k rows per query: Spark goes by their size
    facts = reviews.select(F.col("review_id").alias("id"), "review_key", "review_code", "rating", "sentiment")
    # A hit shows at most the first k products of its code: the others would only be sorted away, k hits times all products.
    of_code = Window.partitionBy("review_code").orderBy("mapping_id")
    names = mapping.select("review_code", "golden_name", "mapping_id").withColumn("_place", F.row_number().over(of_code))
    names = materialize(names.where(F.col("_place") <= k).drop("_place"), "hit-names")
    few = hits.join(facts, "id").join(names, "review_code", "left")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id", "mapping_id")
    return (
        few.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select(
            "query_id",
            F.col("rank").cast("long").alias("rank"),
            F.col("id").alias("review_id"),
            "review_key",
            "sentiment",
            F.col("rating").cast("double").alias("rating"),
            F.coalesce("golden_name", "review_code").alias("product_name"),
            F.col("score").alias("similarity"),
        )
    )


def review_snippets(hits: DataFrame, texts: DataFrame) -> DataFrame:
    """One line per hit: rank, product, rating, sentiment, similarity and the start of the text."""
    # Fixed value: the form of a line.
    line = F.format_string(
        "%d. [%s] Note:%s (%s) — similarité %s\n   %s...",
        "rank",
        "product_name",
        F.col("rating").cast("decimal(3,1)").cast("string"),
        "sentiment",
        F.round(F.col("similarity").cast("decimal(10,6)"), 2).cast("decimal(4,2)").cast("string"),
        F.substring("text", 1, SNIPPET),
    )
    keyed = texts.select(F.col("id").alias("review_key"), "text")
    return keyed.join(materialize(hits, "hits"), "review_key").select("query_id", "rank", line.alias("line"))


def search_recall(exact: DataFrame, approximate: DataFrame) -> DataFrame:
    """Share of the exact hits that the approximate search found, per query."""
    found = approximate.select("query_id", "id").withColumn("hit", F.lit(1))
    joined = exact.join(found, ["query_id", "id"], "left")
    return joined.groupBy("query_id").agg(
        F.count("*").alias("wanted"), F.count("hit").alias("found"), F.round(F.count("hit") / F.count("*"), 4).alias("recall")
    )


def hashed_vectors(texts: DataFrame, dims: int = 64) -> DataFrame:
    """A stand-in encoder: word counts hashed into ``dims`` places, length one."""
    tokens = texts.select("id", words(F.lower(F.coalesce("text", F.lit("")))).alias("tokens"))
    counted = HashingTF(inputCol="tokens", outputCol="v", numFeatures=dims).transform(tokens)
    dense = counted.select("id", vector_to_array("v").alias("v"))
    norm = F.sqrt(dot(F.col("v"), F.col("v")))
    return dense.select(
        "id", F.transform("v", lambda x: F.when(norm > 0, x / norm).otherwise(0.0).cast("float")).alias("vec")
    )


def unindexed_reviews(reviews: DataFrame, vectors: DataFrame) -> DataFrame:
    return reviews.join(vectors.select(F.col("id").alias("review_id")), "review_id", "left_anti")


def upsert(current: DataFrame, updates: DataFrame, key: str) -> DataFrame:
    """Current rows with those of ``updates`` in place of or next to them."""
    return current.join(updates.select(key), key, "left_anti").unionByName(updates)


def embedding_upsert(vectors: DataFrame, reviews: DataFrame, texts: DataFrame, encoder=hashed_vectors) -> DataFrame:
    """The vector table after encoding the reviews that have no vector yet."""
    missing = unindexed_reviews(reviews, vectors).select("review_id", "review_key")
    keyed = texts.select(F.col("id").alias("review_key"), "text")
    todo = missing.join(keyed, "review_key").select(F.col("review_id").alias("id"), "text")
    fresh = encoder(todo).withColumn("origin", F.lit("new"))
    known = vectors.select("id", F.col("vec").cast("array<float>").alias("vec"), F.lit("existing").alias("origin"))
    return upsert(known, fresh, "id")

