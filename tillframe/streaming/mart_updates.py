"""Marts kept up to date by streams: each batch becomes deltas per key, merged into stored facts once.

Facts are what the marts are made of, per key: totals per customer and product,
lines per invoice, review totals per code. A batch is aggregated before it is
merged, so a merge costs the batch and the facts, not the lines before it. The
facts of a stream and the number of its last batch are published together by one
rename: a batch that is run again after a failure changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillframe.operators import marts
from tillframe.operators.cleaning import clean_sales, rename_sales
from tillframe.plans.load import CURRENT, current_version, publish
from tillframe.sources.files import SALES_SCHEMA
from tillframe.sources.manifest import path_exists

REVIEW_SCHEMA = "review_id long, review_code string, rating decimal(3,1), sentiment string"
LINE_SUMS = {"revenue": "decimal(28,2)", "margin": "decimal(28,2)", "quantity": "long", "lines": "long"}
REVIEW_SUMS = {"rating_sum": "decimal(28,1)"} | dict.fromkeys(("ratings", "reviews", "positive", "negative", "neutral"), "long")


def _merged(old: DataFrame | None, delta: DataFrame, keys: list[str], sums: dict[str, str], alive: str) -> DataFrame:
    """Old facts plus deltas; keys whose ``alive`` count has gone back to zero go."""
    rows = delta if old is None else old.unionByName(delta)
    added = rows.groupBy(*keys).agg(*[F.sum(c).cast(t).alias(c) for c, t in sums.items()])
    return added.where(F.col(alive) != 0)


def sales_deltas(lines: DataFrame, sign: Column | None = None) -> dict[str, DataFrame]:
    """Deltas of clean sales lines; ``sign`` is -1 for lines that are taken back."""
    sign = F.lit(1) if sign is None else sign
    parts = {c: F.col(c) * sign for c in ("revenue", "margin", "quantity")} | {"lines": sign}
    signed = lines.select("customer_id", "product_id", "invoice_no", *[v.alias(c) for c, v in parts.items()])
    totals = signed.groupBy("customer_id", "product_id").agg(*[F.sum(c).cast(t).alias(c) for c, t in LINE_SUMS.items()])
    invoices = signed.groupBy("customer_id", "invoice_no").agg(F.sum("lines").cast("long").alias("lines"))
    return {"lines": totals, "invoices": invoices}


def review_deltas(reviews: DataFrame, sign: Column | None = None) -> dict[str, DataFrame]:
    """Deltas of reviews (review_code, rating, sentiment); reviews without a code count for no product."""
    sign = F.lit(1) if sign is None else sign
    coded = reviews.where(F.col("review_code").isNotNull())

    def having(label: str) -> Column:
        return F.sum(F.when(F.col("sentiment") == label, sign).otherwise(0)).cast("long").alias(label)

    rated = F.when(F.col("rating").isNotNull(), sign).otherwise(0)
    totals = coded.groupBy("review_code").agg(
        F.sum(F.coalesce(F.col("rating"), F.lit(0)) * sign).cast(REVIEW_SUMS["rating_sum"]).alias("rating_sum"),
        F.sum(rated).cast("long").alias("ratings"), F.sum(sign).cast("long").alias("reviews"),
        having("positive"), having("negative"), having("neutral"),
    )
    return {"reviews": totals}


KEYS = {
    "lines": (["customer_id", "product_id"], LINE_SUMS, "lines"),
    "invoices": (["customer_id", "invoice_no"], {"lines": "long"}, "lines"),
    "reviews": (["review_code"], REVIEW_SUMS, "reviews"),
}


def facts(spark: SparkSession, target: str, name: str) -> DataFrame:
    """The stored facts ``name`` of ``target``."""
    return spark.read.parquet(f"{current_version(spark, target)}/{name}")


def last_batch(spark: SparkSession, target: str) -> int:
    """The number of the last batch merged into ``target``; -1 before the first."""
    if not path_exists(spark, f"{target}/{CURRENT}"):
        return -1
    return facts(spark, target, "batch").first().number


def merge_batch(target: str, number: int, deltas: dict[str, DataFrame]) -> bool:
    """Add the deltas of batch ``number`` to the facts of ``target``; False if it is in them already."""
    spark = next(iter(deltas.values())).sparkSession
    seen = last_batch(spark, target)
    if seen >= number:
        return False
    old = {name: facts(spark, target, name) if seen >= 0 else None for name in deltas}
    new = {name: _merged(old[name], delta, *KEYS[name]) for name, delta in deltas.items()}
    publish(new | {"batch": spark.createDataFrame([(number,)], "number long")}, target)
    return True


def _run(stream: DataFrame, target: str, checkpoint: str, deltas: Callable[[DataFrame], dict[str, DataFrame]]) -> int:
    done: list[int] = []

    def load(batch: DataFrame, number: int) -> None:
        if merge_batch(target, number, deltas(batch)):
            done.append(number)

    writer = stream.writeStream.foreachBatch(load).option("checkpointLocation", checkpoint)
    writer.trigger(availableNow=True).start().awaitTermination()
    return len(done)


def stream_sales(spark: SparkSession, source: str, target: str, checkpoint: str) -> int:
    """Merge all unseen sales files (CSV) of ``source`` into the facts; returns the batches merged."""
    stream = spark.readStream.schema(SALES_SCHEMA).option("header", True).csv(source)
    return _run(stream, target, checkpoint, lambda batch: sales_deltas(clean_sales(rename_sales(batch))))


def stream_reviews(spark: SparkSession, source: str, target: str, checkpoint: str) -> int:
    """Merge all unseen files of linked reviews (JSON lines) of ``source`` into the facts; returns the batches merged."""
    return _run(spark.readStream.schema(REVIEW_SCHEMA).json(source), target, checkpoint, review_deltas)


def current_marts(spark: SparkSession, sales: str, reviews: str, mapping: DataFrame, customers: DataFrame) -> dict[str, DataFrame]:
    """The marts over the facts of both folders, equal to those over all lines and reviews."""
    lines, codes = facts(spark, sales, "lines"), facts(spark, reviews, "reviews")
    orders = facts(spark, sales, "invoices").groupBy("customer_id").agg(F.count("*").alias("orders"))
    per_product = lines.groupBy("product_id").agg(*[F.sum(c).cast(t).alias(c) for c, t in LINE_SUMS.items()])
    kpi = marts.product_kpi_of_facts(mapping, per_product, codes)
    return {
        "product_kpi": kpi,
        "product_alerts": marts.product_alerts(kpi),
        "customer_kpi": marts.customer_kpi_of_facts(customers, lines, orders, mapping, codes),
    }
