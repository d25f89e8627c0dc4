"""Invoice CSV and review JSON readers, and the CSV writer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillframe.functions.ordering import with_position
from tillframe.operators.cleaning import rename_sales, sample_n

SALES_SCHEMA = T.StructType(
    [
        T.StructField("Invoice", T.StringType()),
        T.StructField("StockCode", T.StringType()),
        T.StructField("Description", T.StringType()),
        T.StructField("Quantity", T.IntegerType()),
        T.StructField("InvoiceDate", T.StringType()),
        T.StructField("Price", T.DecimalType(14, 4)),
        T.StructField("Customer ID", T.StringType()),
        T.StructField("Country", T.StringType()),
    ]
)
REVIEW_SCHEMA = T.StructType(
    [
        T.StructField("review", T.StringType()),
        T.StructField("sentimen", T.IntegerType()),
        T.StructField("sentiment", T.IntegerType()),
        T.StructField("translate", T.StringType()),
    ]
)
SEED = 42


def load_sales(spark: SparkSession, path: str, sample_size: int = 0, seed: int = SEED) -> DataFrame:
    """Invoice lines with canonical column names; an exact sample unless ``sample_size`` is 0."""
    raw = spark.read.schema(SALES_SCHEMA).option("header", True).option("encoding", "UTF-8").csv(path)
    return sample_n(rename_sales(raw), sample_size, seed)


def load_reviews(
    spark: SparkSession, path: str, n: int = 0, seed: int = SEED, json_lines: bool = True
) -> DataFrame:
    """Reviews as ``review_key``, ``review_text`` and ``sentiment_flag``; a sample unless ``n`` is 0.

    JSON lines are split over tasks. A file that holds one JSON array
    (``json_lines=False``) is parsed by one task: convert it once with
    ``json_array_to_lines`` if it is large.
    """
    raw = spark.read.schema(REVIEW_SCHEMA).option("multiLine", not json_lines).json(path)
    texts = raw.select(
        F.coalesce("translate", "review", F.lit("")).alias("review_text"),
        F.coalesce("sentimen", "sentiment", F.lit(1)).alias("sentiment_flag"),
    )
    picked = sample_n(texts, n, seed)
    order = [F.xxhash64(F.lit(seed), "review_text", "sentiment_flag"), "review_text", "sentiment_flag"]
    return with_position(picked, order, "review_key")


def json_array_to_lines(spark: SparkSession, path: str, target: str) -> None:
    """Write a file of one JSON array as JSON lines, spread over files."""
    spark.read.schema(REVIEW_SCHEMA).option("multiLine", True).json(path).repartition(
        spark.sparkContext.defaultParallelism
    ).write.mode("overwrite").json(target)


def export_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)
