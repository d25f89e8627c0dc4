"""The published tables that marts and reports read.

Sales are cleaned and joined once and stored, as are products, customers, the
mapping and the review facts. Review texts stay in their source and are joined
only where a report shows them.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillframe.functions.ordering import with_position
from tillframe.operators import cleaning, marts, matching, search, vector_index
from tillframe.operators.analytics import CUSTOMER_METRICS, Clusters
from tillframe.operators.churn import ChurnModel, churn_labels, customer_rfm_base
from tillframe.session import tune
from tillframe.sources import tables
from tillframe.sources.storage import SMALL_BYTES, materialize, scan_bytes


class Warehouse:
    """Tables over one folder of source data, each built when first used."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = tune(spark), folder

    def table(self, name: str) -> DataFrame:
        return tables.read_table(self.spark, self.folder, name)

    @cached_property
    def raw_sales(self) -> DataFrame:
        return tables.raw_sales(self.spark, self.folder)

    @cached_property
    def raw_reviews(self) -> DataFrame:
        return tables.raw_reviews(self.spark, self.folder)

    @cached_property
    def sales(self) -> DataFrame:
        """Clean lines by time: reports over a period read only its files, or its pages of each file.

        The lines of a large table are not moved for it: those of an order come out together, and stay so.
        """
        by_time = ["invoice_ts", "invoice_no", "product_id"]
        lines = cleaning.clean_sales(self.raw_sales)
        small = scan_bytes(lines) <= SMALL_BYTES
        return materialize(lines, "sales", cluster_by=by_time) if small else materialize(lines, "sales", sort_by=by_time)

    @cached_property
    def products(self) -> DataFrame:
        return materialize(cleaning.ranked_products(self.sales), "products")

    @cached_property
    def product_rows(self) -> int:
        return self.products.count()

    @cached_property
    def customers(self) -> DataFrame:
        return materialize(cleaning.distinct_customers(self.sales), "customers")

    @cached_property
    def mapping(self) -> DataFrame:
        """Products by exact code, then edit similarity, then n-grams, then rank."""
        return materialize(matching.golden_records(self.products), "mapping")

    @cached_property
    def reviews(self) -> DataFrame:
        """Review facts without their texts, linked to products by the words of the whole text."""
        return materialize(self.review_facts.join(self.linked.drop("score"), "review_key"), "reviews")

    @cached_property
    def linked(self) -> DataFrame:
        """Reviews by key with the code of their product and the score of the link."""
        found = matching.attach_reviews_tfidf(self.raw_reviews, self.mapping)
        return materialize(found.select("review_key", "review_code", "score"), "linked")

    @cached_property
    def reviews_poc(self) -> DataFrame:
        """The same facts, dealt out to the products in turn."""
        return materialize(matching.attach_reviews_rr(self.review_facts.drop("review_id"), self.mapping_poc), "reviews-poc")

    @cached_property
    def mapping_poc(self) -> DataFrame:
        return materialize(matching.golden_records(self.products, strategy="poc"), "mapping-poc")

    @cached_property
    def review_facts(self) -> DataFrame:
        """Facts by review, numbered from 1 in the order of their keys."""
        # Facts need to know whether there is a text, so that is what the labels meet.
        emptied = self.table("documents").select(F.col("doc_id").alias("id"), F.when(F.col("text").isNotNull(), F.lit("")).alias("text"))
        cleaned = cleaning.clean_reviews(tables.raw_reviews(self.spark, self.folder, emptied))
        facts = cleaned.select("review_key", "sentiment", "rating", "review_ts", F.col("review_text").isNotNull().alias("has_text"))
        placed = with_position(facts, ["review_key"], "review_id")
        return materialize(placed.withColumn("review_id", F.col("review_id") + 1), "review-facts")

    @cached_property
    def vector_index(self) -> vector_index.VectorIndex:
        return vector_index.build_index(self.vectors, search.K)

    @cached_property
    def texts(self) -> DataFrame:
        return tables.review_texts(self.spark, self.folder)

    @cached_property
    def product_kpi(self) -> DataFrame:
        return materialize(marts.product_kpi(self.mapping, self.sales, self.reviews), "product-kpi")

    @cached_property
    def kpi_poc(self) -> DataFrame:
        """Products with the reviews dealt out in turn: every product has some, every status occurs."""
        return materialize(marts.product_kpi(self.mapping_poc, self.sales, self.reviews_poc), "product-kpi-poc")

    @cached_property
    def alerts_poc(self) -> DataFrame:
        return marts.product_alerts(self.kpi_poc)

    @cached_property
    def named_texts(self) -> DataFrame:
        """Review texts that begin with the name of a product, dealt out in turn: texts that share words with names."""
        names = self.products.select("idx", "product_name")
        placed = self.review_facts.select("review_key", F.pmod(F.col("review_id") - 1, F.lit(self.product_rows)).alias("idx"))
        # Names first: the texts move once, and are stored as they come.
        named = placed.join(names, "idx").select("review_key", "product_name")
        whole = self.texts.join(named, named.review_key == F.col("id"))
        return materialize(whole.select("review_key", F.concat_ws(" ", "product_name", "text").alias("review_text")), "named-texts", codec="zstd")

    @cached_property
    def reviews_spread(self) -> DataFrame:
        """As ``reviews``, but reviews that share no word with any product are dealt out to the products in turn."""
        dealt = matching.attach_reviews_rr(self.review_facts.drop("review_id"), self.mapping).withColumnRenamed("review_code", "dealt")
        code = F.when(F.col("score") > 0, F.col("review_code")).otherwise(F.col("dealt"))
        return materialize(dealt.join(self.linked, "review_key").withColumn("review_code", code).drop("dealt", "score"), "reviews-spread")

    @cached_property
    def kpi_spread(self) -> DataFrame:
        """Products matched by all ways, with their linked and dealt reviews: many have some."""
        return materialize(marts.product_kpi(self.mapping, self.sales, self.reviews_spread), "product-kpi-spread")

    @cached_property
    def alerts_spread(self) -> DataFrame:
        return marts.product_alerts(self.kpi_spread)

    @cached_property
    def alerts(self) -> DataFrame:
        return marts.product_alerts(self.product_kpi)

    @cached_property
    def customer_kpi(self) -> DataFrame:
        kpi = marts.customer_kpi(self.customers, self.sales, self.mapping, self.reviews, self.product_rows)
        return materialize(kpi, "customer-kpi")

    @cached_property
    def rfm_base(self) -> DataFrame:
        return materialize(customer_rfm_base(self.customers, self.sales), "rfm-base")

    @cached_property
    def churn_model(self) -> ChurnModel:
        return ChurnModel(churn_labels(self.rfm_base))

    @cached_property
    def clusters(self) -> Clusters:
        return Clusters(self.customer_kpi, "customer_id", CUSTOMER_METRICS)

    @cached_property
    def messages(self) -> DataFrame:
        return tables.messages(self.spark, self.folder)

    @cached_property
    def vectors(self) -> DataFrame:
        """Review vectors as (id, vec, label); vector n belongs to review n + 1."""
        rows = tables.embeddings(self.spark, self.folder)
        return rows.select((F.col("vec_id") + 1).alias("id"), F.col("embedding").alias("vec"), "label")


_open: dict[tuple[str, str], Warehouse] = {}


def warehouse(spark: SparkSession, folder: str) -> Warehouse:
    """The warehouse of this application over ``folder``; its tables are built once."""
    key = (spark.sparkContext.applicationId, folder)
    if key not in _open:
        _open[key] = Warehouse(spark, folder)
    return _open[key]


def forget(spark: SparkSession, folder: str) -> None:
    """Build the tables anew at the next use, for sources that have changed."""
    _open.pop((spark.sparkContext.applicationId, folder), None)
