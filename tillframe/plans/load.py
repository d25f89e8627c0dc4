"""The batch load: read, clean, match, check, publish."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillframe.functions.skew import join_keyed
from tillframe.operators import cleaning, marts, matching, quality
from tillframe.sources.files import load_reviews, load_sales
from tillframe.sources.manifest import path_exists, record_sources, should_run
from tillframe.sources.storage import materialize

TABLES = ("products", "customers", "mapping", "sales", "reviews")
HISTORY = "mapping_history"
CURRENT = "current"  # names the folder of the published version


def run_load(
    spark: SparkSession,
    sales_path: str,
    reviews_path: str,
    target: str,
    force: bool = False,
    sales_sample: int = 0,
    review_sample: int = 0,
    mapped_products: int = 0,
    strategy: str = "semantic",
    json_lines: bool = True,
    encoder: Callable[[DataFrame], DataFrame] | None = None,
    as_of: datetime | None = None,
) -> bool:
    """Load both sources into ``target`` unless nothing changed; True when it ran.

    Everything is checked before the first table is replaced, so a failed check
    leaves the published tables as they were. Samples and ``mapped_products``
    (the best sellers that take part in the mapping) are 0 for all. ``encoder``
    turns (id, text) into (id, vec); with it the semantic strategy assigns
    reviews by their vectors. The history of the mapping is kept over all loads: rows
    that change are closed at ``as_of`` (now, by default) and opened anew.
    """
    sources, manifest = [sales_path, reviews_path], f"{target}/_manifest"
    needed, seen = should_run(spark, sources, manifest, force)
    if not needed:
        return False
    sales = materialize(cleaning.clean_sales(load_sales(spark, sales_path, sales_sample)), "load-sales")
    catalogue = cleaning.ranked_products(sales)
    mapped = catalogue.where(F.col("idx") < mapped_products) if mapped_products else catalogue
    mapping = materialize(matching.golden_records(mapped, strategy), "load-mapping")
    raw = load_reviews(spark, reviews_path, review_sample, json_lines=json_lines)
    reviews = cleaning.clean_reviews(raw)
    attached = materialize(attach_reviews(reviews, mapping, strategy, encoder), "load-reviews")
    report = quality.dq_report(
        [quality.dq_sales(sales), quality.dq_reviews(attached), quality.dq_products(mapped)]
    )
    quality.quality_gate(report, force)
    publish(
        {
            "products": catalogue.select("product_id", "product_name", "category"),
            "customers": cleaning.distinct_customers(sales),
            "mapping": mapping,
            "sales": sales.select(
                F.monotonically_increasing_id().alias("fact_id"),
                "invoice_no", "product_id", "quantity", "revenue", "margin", "invoice_ts", "customer_id",
            ),
            "reviews": attached.select(
                "review_id", "review_code", "rating", "review_text", "review_excerpt", "sentiment", "review_ts"
            ),
            HISTORY: mapping_history(spark, target, mapping, as_of),
        },
        target,
    )
    record_sources(seen, manifest)
    return True


def mapping_history(spark: SparkSession, target: str, mapping: DataFrame, as_of: datetime | None = None) -> DataFrame:
    """The stored history of ``target``, brought up to ``mapping``: open rows hold, closed ones held before."""
    columns = ["product_id", *matching.HISTORY_VALUES, "valid_from", "valid_to"]
    now = F.lit(as_of or datetime.now(timezone.utc).replace(tzinfo=None)).cast("timestamp_ntz")
    stored = f"{current_version(spark, target)}/{HISTORY}" if path_exists(spark, f"{target}/{CURRENT}") else None
    if stored and path_exists(spark, stored):
        return matching.update_history(spark.read.parquet(stored), mapping, now).select(*columns)
    never = F.lit(None).cast("timestamp_ntz")
    return mapping.withColumn("valid_from", now).withColumn("valid_to", never).select(*columns)


def attach_reviews(
    reviews: DataFrame, mapping: DataFrame, strategy: str, encoder: Callable[[DataFrame], DataFrame] | None = None
) -> DataFrame:
    """Reviews with a code: by vectors, by words, or in turn."""
    if strategy == "poc":
        return matching.attach_reviews_rr(reviews, mapping)
    found = None
    if strategy == "semantic" and encoder is not None:
        texts = reviews.select(F.col("review_key").alias("id"), F.col("review_text").alias("text"))
        names = mapping.select((F.col("mapping_id") - 1).alias("id"), F.col("golden_name").alias("text"))
        assigned = materialize(matching.semantic_assign(encoder(texts), encoder(names)), "assigned")
        if assigned.where("confident").limit(1).count():
            codes = mapping.select((F.col("mapping_id") - 1).alias("product_idx"), "review_code")
            found = join_keyed(assigned, codes, "product_idx", "inner")
    if found is None:
        found = matching.attach_reviews_tfidf(reviews, mapping)
    attached = reviews.join(found.select("review_key", "review_code"), "review_key")
    return attached.withColumn("review_id", F.col("review_key") + 1)


def _paths(spark: SparkSession):
    jvm = spark.sparkContext._jvm
    return jvm, spark.sparkContext._jsc.hadoopConfiguration()


def current_version(spark: SparkSession, target: str) -> str:
    """The folder of the published version."""
    return f"{target}/{spark.read.text(f'{target}/{CURRENT}').first().value}"


def publish(frames: dict[str, DataFrame], target: str) -> None:
    """Replace the tables under ``target`` all at once.

    The tables are written into a folder of their own; then one file, which
    names the folder, is replaced. Until then readers see the old version, also
    if a write fails. The version before is removed at the end.
    """
    spark = next(iter(frames.values())).sparkSession
    jvm, conf = _paths(spark)
    version = f"version-{uuid.uuid4().hex[:12]}"
    for name, df in frames.items():
        df.write.parquet(f"{target}/{version}/{name}")
    path = jvm.org.apache.hadoop.fs.Path
    fs = path(target).getFileSystem(conf)
    old = current_version(spark, target) if fs.exists(path(f"{target}/{CURRENT}")) else None
    note = fs.create(path(f"{target}/.{version}.note"), True)
    note.write(bytearray(version.encode()))
    note.close()
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(path(target).toUri(), conf)
    option = jvm.org.apache.hadoop.fs.Options.Rename
    options = spark.sparkContext._gateway.new_array(option, 1)
    options[0] = option.OVERWRITE
    files.rename(path(f"{target}/.{version}.note"), path(f"{target}/{CURRENT}"), options)
    if old:
        fs.delete(path(old), True)


def empty_tables(spark: SparkSession, target: str) -> None:
    """Remove all rows from the published tables, keeping their columns and the history of the mapping."""
    folder = current_version(spark, target)
    kept = {HISTORY: spark.read.parquet(f"{folder}/{HISTORY}")} if path_exists(spark, f"{folder}/{HISTORY}") else {}
    publish({name: spark.read.parquet(f"{folder}/{name}").limit(0) for name in TABLES} | kept, target)


def create_views(spark: SparkSession, target: str) -> None:
    """Register the published tables and the four marts under their names."""
    folder = current_version(spark, target)
    t = {name: spark.read.parquet(f"{folder}/{name}") for name in TABLES}
    for name, df in t.items():
        df.createOrReplaceTempView(name)
    kpi = marts.product_kpi(t["mapping"], t["sales"], t["reviews"])
    kpi.createOrReplaceTempView("product_kpi")
    marts.product_alerts(kpi).createOrReplaceTempView("product_alerts")
    marts.customer_kpi(t["customers"], t["sales"], t["mapping"], t["reviews"]).createOrReplaceTempView("customer_kpi")
    marts.data_quality_summary(
        t["products"], t["customers"], t["mapping"], t["sales"], t["reviews"]
    ).createOrReplaceTempView("data_quality_summary")
