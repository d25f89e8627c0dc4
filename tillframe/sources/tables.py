"""Parquet tables in the order-management layout as invoice lines and reviews."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillframe.functions.skew import BROADCAST_ROWS, join_keyed
from tillframe.sources.storage import spread


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def raw_sales(spark: SparkSession, folder: str) -> DataFrame:
    """Order lines as invoice lines; returned lines get a cancelled invoice number.

    The unit price is the line amount over the quantity, to the cent. Parts join by
    ``join_keyed``, which spreads the lines of a hot product. Orders get their
    customer's country first. They join last unless parts are broadcast, so the lines
    of an order come out together.
    """
    line = read_table(spark, folder, "lineitem").select(
        "l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_returnflag"
    )
    scanned, line = line, spread(line)
    order = read_table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    part = read_table(spark, folder, "part").select("p_partkey", "p_name")
    customer = read_table(spark, folder, "customer").select("c_custkey", "c_nationkey")
    nation = read_table(spark, folder, "nation").select("n_nationkey", "n_name")
    located = customer.join(nation, customer.c_nationkey == nation.n_nationkey).select("c_custkey", "n_name")
    placed = order.join(located, order.o_custkey == located.c_custkey)
    named = part.select(F.col("p_partkey").alias("l_partkey"), "p_name")
    parts = named.count()
    if parts <= BROADCAST_ROWS:
        joined = join_keyed(line.join(placed, line.l_orderkey == placed.o_orderkey), named, "l_partkey", "inner", keyed_rows=parts)
    else:
        described = join_keyed(line, named, "l_partkey", "inner", keyed_rows=parts, keys_of=scanned)
        joined = described.join(placed, described.l_orderkey == placed.o_orderkey)
    variant = F.substring(F.lit("ABCD"), (F.col("l_partkey") % 4 + 1).cast("int"), F.lit(1))
    # Half-up on whole cents; a line without a quantity has no price.
    price = F.expr(
        "(2 * cast(round(l_extendedprice * 100) as bigint) + cast(l_quantity as bigint))"
        " div nullif(2 * cast(l_quantity as bigint), 0)"
    )
    return joined.select(
        (F.col("l_orderkey") * 7 + F.col("l_linenumber") * 13).alias("line_key"),
        F.concat(
            F.when(F.col("l_returnflag") == "R", "C").otherwise(""), F.col("l_orderkey").cast("string")
        ).alias("invoice_no"),
        F.concat(F.expr("l_partkey div 4").cast("string"), variant).alias("product_id"),
        F.upper("p_name").alias("description"),
        F.col("l_quantity").cast("int").alias("quantity"),
        (price.cast("decimal(16,0)") * F.lit("0.01").cast("decimal(2,2)")).cast("decimal(14,4)").alias("unit_price"),
        F.col("o_orderdate").cast("timestamp_ntz").alias("invoice_ts"),
        F.col("o_custkey").cast("string").alias("customer_id"),
        F.col("n_name").alias("country"),
    )


def review_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Whole review texts: (id, text)."""
    documents = read_table(spark, folder, "documents")
    return spread(documents.select(F.col("doc_id").alias("id"), "text"))


def raw_reviews(spark: SparkSession, folder: str, texts: DataFrame | None = None) -> DataFrame:
    """Documents, or ``texts`` (id, text), as review texts, with the quality label as the sentiment flag."""
    labels = read_table(spark, folder, "labels").select(F.col("doc_id").alias("id"), "quality")
    texts = review_texts(spark, folder) if texts is None else texts
    return texts.join(labels, "id", "left").select(
        F.col("id").alias("review_key"),
        F.col("text").alias("review_text"),
        F.col("quality").alias("sentiment_flag"),
    )


def messages(spark: SparkSession, folder: str) -> DataFrame:
    """Conversation turns: session, place in the session, role, content and time.

    The source has no times: a session starts at a minute of 2024 given by its
    number, and each turn follows a minute after the last.
    """
    minute = F.pmod(F.col("conv_id") * 7919, F.lit(525_600)) + F.col("turn")
    return read_table(spark, folder, "conversations").select(
        F.col("conv_id").alias("session_id"),
        F.col("turn").alias("seq"),
        "role",
        F.col("text").alias("content"),
        F.timestamp_seconds(F.lit(1_704_067_200) + minute * 60).cast("timestamp_ntz").alias("sent_at"),
    )


def embeddings(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "embeddings").select("vec_id", "embedding", "label")
