"""The query registry: name -> (spark, folder) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillframe.functions.ordering import with_scalars
from tillframe.functions.text import name_keywords
from tillframe.operators import (
    analytics, churn, cleaning, conversation, forecast, marts, matching, quality, reports, search, smoothing, vector_index,
)
from tillframe.plans.warehouse import Warehouse, warehouse
from tillframe.sources.storage import materialize

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

SAMPLE_ROWS = 500
FULL_NAME_THRESHOLD = 0.25
CHECK_NOW = "2024-01-01 00:00:00"
RULES_NOW = "2000-01-01 00:00:00"
RANGE = ("1996-01-01", "1999-12-31")
HISTORY_FROM, HISTORY_AS_OF = "1996-01-01 00:00:00", "1999-01-01 00:00:00"


def query(build: Callable[[Warehouse], DataFrame]) -> Callable[[Warehouse], DataFrame]:
    """Register ``build`` under its name."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        return build(warehouse(spark, folder))

    QUERIES[build.__name__] = run
    return build


def _doubles(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("double") for c in columns})


# --- sources and cleaning ----------------------------------------------------


@query
def clean_sales(w: Warehouse) -> DataFrame:
    return _doubles(cleaning.clean_sales(w.raw_sales), "unit_price", "revenue", "margin")


@query
def sample_n(w: Warehouse) -> DataFrame:
    lines = w.raw_sales.select("line_key", "invoice_no", "product_id", "quantity", "unit_price")
    picked = cleaning.sample_n(lines, SAMPLE_ROWS, key=["line_key", "invoice_no", "product_id", "quantity"])
    return _doubles(picked, "unit_price").withColumn("quantity", F.col("quantity").cast("long"))


@query
def clean_reviews(w: Warehouse) -> DataFrame:
    return _doubles(cleaning.clean_reviews(w.raw_reviews), "rating")


@query
def table_profile(w: Warehouse) -> DataFrame:
    return marts.table_profile(
        {
            "products": w.products.drop("idx", "quantity"),
            "customers": w.customers,
            "mapping": w.mapping,
            "sales": w.sales,
            "reviews": w.reviews,
            "conversations": w.messages,
            "embeddings": w.vectors,
        }
    )


@query
def top_products(w: Warehouse) -> DataFrame:
    return cleaning.top_products(w.sales)


@query
def ranked_products(w: Warehouse) -> DataFrame:
    return cleaning.ranked_products(w.sales)


@query
def distinct_customers(w: Warehouse) -> DataFrame:
    return cleaning.distinct_customers(w.sales)


@query
def categorize_products(w: Warehouse) -> DataFrame:
    return cleaning.categorize_products(w.products.select("product_id", "product_name"))


@query
def categorize_products_mdm(w: Warehouse) -> DataFrame:
    return cleaning.categorize_products_mdm(w.products.select("product_id", "product_name"))


@query
def normalize_codes(w: Warehouse) -> DataFrame:
    return w.products.select("product_id", cleaning.normalize_code(F.col("product_id")).alias("code"))


@query
def category_list(w: Warehouse) -> DataFrame:
    return reports.category_list(w.products)


@query
def fk_orphans(w: Warehouse) -> DataFrame:
    return marts.fk_orphans(
        [
            ("sales.customer_id", w.sales, "customer_id", w.customers, "customer_id"),
            ("sales.product_id", w.sales, "product_id", w.products, "product_id"),
            ("mapping.product_id", w.mapping, "product_id", w.products, "product_id"),
            ("reviews.review_code", w.reviews, "review_code", w.mapping, "review_code"),
            ("mapping.review_code", w.mapping, "review_code", w.reviews, "review_code"),
            ("embeddings.id", w.vectors, "id", w.reviews, "review_id"),
        ]
    )


# --- marts -----------------------------------------------------------------------


@query
def product_kpi(w: Warehouse) -> DataFrame:
    return marts.product_kpi(w.mapping, w.sales, w.reviews)


@query
def product_kpi_exact(w: Warehouse) -> DataFrame:
    return marts.product_kpi_exact(w.mapping, w.sales, w.reviews)


@query
def product_kpi_poc(w: Warehouse) -> DataFrame:
    return w.kpi_poc


@query
def product_alerts_poc(w: Warehouse) -> DataFrame:
    return w.alerts_poc


@query
def customer_kpi(w: Warehouse) -> DataFrame:
    return marts.customer_kpi(w.customers, w.sales, w.mapping, w.reviews, w.product_rows)


@query
def customer_kpi_exact(w: Warehouse) -> DataFrame:
    return marts.customer_kpi_exact(w.customers, w.sales, w.mapping, w.reviews, w.product_rows)


@query
def product_alerts(w: Warehouse) -> DataFrame:
    return w.alerts


@query
def data_quality_summary(w: Warehouse) -> DataFrame:
    return marts.data_quality_summary(w.products, w.customers, w.mapping, w.sales, w.reviews)


@query
def match_strategy_counts(w: Warehouse) -> DataFrame:
    return marts.match_strategy_counts(w.mapping)


# --- business questions ------------------------------------------------------------


@query
def dashboard_totals(w: Warehouse) -> DataFrame:
    return reports.dashboard_totals(w.product_kpi)


@query
def product_listing(w: Warehouse) -> DataFrame:
    return reports.product_listing(w.product_kpi, w.alerts)


@query
def product_listing_filtered(w: Warehouse) -> DataFrame:
    return reports.product_listing(
        w.kpi_spread, w.alerts_spread, category="Art de la Table", status="OK", sort_by="rating"
    )


@query
def revenue_by_category(w: Warehouse) -> DataFrame:
    return reports.revenue_by_category(w.product_kpi)


@query
def open_alerts(w: Warehouse) -> DataFrame:
    return reports.open_alerts(w.alerts_spread)


@query
def critical_products(w: Warehouse) -> DataFrame:
    return reports.critical_by_strategy({"semantic": w.alerts_spread, "poc": w.alerts_poc})


@query
def alert_messages(w: Warehouse) -> DataFrame:
    return reports.alert_messages(critical_products(w))


@query
def product_sheet_sales(w: Warehouse) -> DataFrame:
    return reports.product_sheet_sales(w.sales)


@query
def product_sheet_reviews(w: Warehouse) -> DataFrame:
    return reports.product_sheet_reviews(w.mapping, w.reviews_spread)


@query
def product_monthly_revenue(w: Warehouse) -> DataFrame:
    return reports.product_monthly_revenue(w.sales)


@query
def rating_distribution(w: Warehouse) -> DataFrame:
    return reports.rating_distribution(w.products, w.mapping, w.reviews, w.texts)


@query
def latest_reviews(w: Warehouse) -> DataFrame:
    return reports.latest_reviews(w.products, w.mapping, w.reviews, w.texts)


@query
def review_keyword_search(w: Warehouse) -> DataFrame:
    return reports.review_keyword_search(w.texts, w.products)


@query
def mapping_extract(w: Warehouse) -> DataFrame:
    return reports.mapping_extract(w.mapping)


@query
def coverage_by_category(w: Warehouse) -> DataFrame:
    return reports.coverage_by_category(w.mapping, w.reviews)


@query
def revenue_by_period(w: Warehouse) -> DataFrame:
    return reports.revenue_by_period(w.sales, "month", *RANGE)


@query
def revenue_by_quarter(w: Warehouse) -> DataFrame:
    return reports.revenue_by_period(w.sales, "quarter", *RANGE)


@query
def revenue_by_year(w: Warehouse) -> DataFrame:
    return reports.revenue_by_period(w.sales, "year", *RANGE)


@query
def period_totals(w: Warehouse) -> DataFrame:
    return reports.period_totals(reports.revenue_by_period(w.sales, "month", *RANGE))


@query
def period_top_products(w: Warehouse) -> DataFrame:
    return reports.period_top_products(w.sales, w.mapping, *RANGE)


@query
def sales_by_country(w: Warehouse) -> DataFrame:
    return reports.sales_by_country(w.sales, w.customers)


@query
def geo_totals(w: Warehouse) -> DataFrame:
    return reports.geo_totals(reports.sales_by_country(w.sales, w.customers))


def _compared(w: Warehouse) -> DataFrame:
    return reports.product_comparison(w.product_kpi, reports.best_sellers(w.product_kpi, 4))


@query
def product_comparison(w: Warehouse) -> DataFrame:
    return _compared(w)


@query
def comparison_transposed(w: Warehouse) -> DataFrame:
    return reports.comparison_transposed(_compared(w))


@query
def monthly_revenue(w: Warehouse) -> DataFrame:
    return reports.monthly_revenue(w.sales)


@query
def best_sellers(w: Warehouse) -> DataFrame:
    return reports.best_sellers(w.product_kpi)


@query
def top_customers(w: Warehouse) -> DataFrame:
    return reports.top_customers(w.customer_kpi)


@query
def best_rated_products(w: Warehouse) -> DataFrame:
    return reports.best_rated_products(w.product_kpi)


@query
def worst_rated_products(w: Warehouse) -> DataFrame:
    return reports.worst_rated_products(w.alerts_spread)


@query
def customer_satisfaction(w: Warehouse) -> DataFrame:
    return reports.customer_satisfaction(w.customer_kpi, w.sales, w.mapping, w.reviews, None, w.product_rows)


@query
def customer_satisfaction_top(w: Warehouse) -> DataFrame:
    return reports.customer_satisfaction(w.customer_kpi, w.sales, w.mapping, w.reviews, 200, w.product_rows)


# --- data quality ---------------------------------------------------------------------


@query
def dq_rules(w: Warehouse) -> DataFrame:
    rules = [
        quality.no_nulls("sentiment_flag"),
        quality.min_rows(1_000_000_000),
        quality.unique("sentiment_flag"),
        quality.values_in_set("sentiment_flag", (0,)),
        quality.column_between("review_key", 5, 100),
        quality.positive_values("review_key", "warning"),
    ]
    lines = [quality.no_future_dates("invoice_ts", RULES_NOW), quality.values_in_set("country", ("NATION_0", "NATION_1"), "warning")]
    return quality.run_suite(w.raw_reviews, "raw_reviews", rules).unionByName(
        quality.run_suite(w.raw_sales, "raw_sales", lines)
    )


@query
def dq_sales(w: Warehouse) -> DataFrame:
    return quality.dq_sales(w.sales, CHECK_NOW)


def _reviews_with_text(w: Warehouse) -> DataFrame:
    """Review facts next to a stand-in that is null where the text is: the rules ask for no more."""
    return w.reviews.withColumn("review_text", F.when(F.col("has_text"), F.lit("")))


@query
def dq_reviews(w: Warehouse) -> DataFrame:
    return quality.dq_reviews(_reviews_with_text(w))


@query
def dq_products(w: Warehouse) -> DataFrame:
    return quality.dq_products(w.products)


@query
def dq_report(w: Warehouse) -> DataFrame:
    return quality.dq_report(
        [quality.dq_sales(w.sales, CHECK_NOW), quality.dq_reviews(_reviews_with_text(w)), quality.dq_products(w.products)]
    )


@query
def dq_constraints(w: Warehouse) -> DataFrame:
    return quality.dq_constraints(
        {"products": w.products, "customers": w.customers, "mapping": w.mapping, "sales": w.sales, "reviews": w.reviews}
    )


# --- matching ----------------------------------------------------------------------------


def _names(w: Warehouse) -> DataFrame:
    return w.products.select("idx", F.col("product_name").alias("name"))


def _full_names(w: Warehouse) -> DataFrame:
    """Catalogue names of many distinct values: name and type of each part."""
    full = F.upper(F.concat_ws(" ", "p_name", "p_type"))
    return w.table("part").select(F.col("p_partkey").alias("idx"), full.alias("name"))


def _distinct_names(w: Warehouse) -> DataFrame:
    return _full_names(w).groupBy("name").agg(F.min("idx").alias("idx"))


@query
def hard_match(w: Warehouse) -> DataFrame:
    return matching.hard_match(w.products, w.product_rows)


@query
def fuzzy_match(w: Warehouse) -> DataFrame:
    return matching.fuzzy_match(w.products)


@query
def fuzzy_match_distinct(w: Warehouse) -> DataFrame:
    short = _names(w).groupBy("name").agg(F.min("idx").alias("idx"))
    return matching.fuzzy_match(short.withColumnRenamed("name", "product_name"))


@query
def fuzzy_match_full(w: Warehouse) -> DataFrame:
    return matching.fuzzy_match(_distinct_names(w).withColumnRenamed("name", "product_name"))


@query
def tfidf_match(w: Warehouse) -> DataFrame:
    return matching.tfidf_match(_names(w))


@query
def tfidf_match_other(w: Warehouse) -> DataFrame:
    return matching.tfidf_match(_distinct_names(w), threshold=FULL_NAME_THRESHOLD, include_self=False)


@query
def rank_match(w: Warehouse) -> DataFrame:
    return matching.rank_match(w.products)


@query
def golden_records(w: Warehouse) -> DataFrame:
    return matching.golden_records(w.products)


@query
def golden_records_words(w: Warehouse) -> DataFrame:
    return matching.golden_records(w.products, use_fuzzy=False)


@query
def golden_records_poc(w: Warehouse) -> DataFrame:
    return matching.golden_records(w.products, strategy="poc")


@query
def match_quality(w: Warehouse) -> DataFrame:
    return matching.match_quality(w.mapping)


@query
def hybrid_match(w: Warehouse) -> DataFrame:
    distinct = _distinct_names(w).withColumnRenamed("name", "product_name")
    return matching.hybrid_match(distinct, FULL_NAME_THRESHOLD)


@query
def mapping_history(w: Warehouse) -> DataFrame:
    first = matching.golden_records(w.products, strategy="poc")
    history = first.select(
        "product_id",
        *matching.HISTORY_VALUES,
        F.lit(HISTORY_FROM).cast("timestamp_ntz").alias("valid_from"),
        F.lit(None).cast("timestamp_ntz").alias("valid_to"),
    )
    return matching.update_history(history, w.mapping, F.lit(HISTORY_AS_OF).cast("timestamp_ntz"))


@query
def sales_mapping_as_of(w: Warehouse) -> DataFrame:
    """Lines and revenue per product and the review code that was valid when they were sold."""
    dated = matching.mapping_as_of(w.sales.select("product_id", "invoice_ts", "revenue"), mapping_history(w), "invoice_ts")
    totals = dated.groupBy("product_id", "review_code", "match_strategy").agg(F.count("*").alias("lines"), F.sum("revenue").alias("r"))
    return totals.select("product_id", "review_code", "match_strategy", "lines", F.col("r").cast("double").alias("revenue"))


@query
def attach_reviews_rr(w: Warehouse) -> DataFrame:
    return matching.attach_reviews_rr(w.raw_reviews.select("review_key"), w.mapping)


@query
def attach_reviews_tfidf(w: Warehouse) -> DataFrame:
    texts = w.texts.select(F.col("id").alias("review_key"), F.col("text").alias("review_text"))
    return matching.attach_reviews_tfidf(texts, w.mapping)


@query
def attach_reviews_named(w: Warehouse) -> DataFrame:
    """As ``attach_reviews_tfidf``, over texts that begin with a product's name."""
    return matching.attach_reviews_tfidf(w.named_texts, w.mapping)


@query
def rating_distribution_poc(w: Warehouse) -> DataFrame:
    return reports.rating_distribution(w.products, w.mapping_poc, w.reviews_poc, w.texts)


@query
def latest_reviews_poc(w: Warehouse) -> DataFrame:
    return reports.latest_reviews(w.products, w.mapping_poc, w.reviews_poc, w.texts)


def _centroids(w: Warehouse) -> DataFrame:
    return search.centroids(w.vectors, "label", "vec")


@query
def semantic_assign(w: Warehouse) -> DataFrame:
    return matching.semantic_assign(w.vectors.select("id", "vec"), _centroids(w), threshold=0.30)


# --- analytics -----------------------------------------------------------------------------


@query
def column_summary(w: Warehouse) -> DataFrame:
    return analytics.column_summary(w.product_kpi, analytics.PRODUCT_METRICS)


@query
def correlation_matrix(w: Warehouse) -> DataFrame:
    return analytics.correlation_matrix(w.product_kpi, analytics.PRODUCT_METRICS)


@query
def monthly_trend(w: Warehouse) -> DataFrame:
    return analytics.monthly_trend(w.sales)


@query
def customer_segments(w: Warehouse) -> DataFrame:
    return analytics.customer_segments(w.customer_kpi)


@query
def segment_profile(w: Warehouse) -> DataFrame:
    return analytics.segment_profile(analytics.customer_segments(w.customer_kpi))


@query
def rfm_scores(w: Warehouse) -> DataFrame:
    return analytics.rfm_scores(w.customer_kpi)


@query
def rfm_profile(w: Warehouse) -> DataFrame:
    return analytics.rfm_profile(analytics.rfm_scores(w.customer_kpi))


@query
def customer_clusters(w: Warehouse) -> DataFrame:
    return w.clusters.labelled


@query
def cluster_profile(w: Warehouse) -> DataFrame:
    return w.clusters.profile()


@query
def cluster_importance(w: Warehouse) -> DataFrame:
    return w.clusters.importance()


@query
def customer_rfm_base(w: Warehouse) -> DataFrame:
    return churn.customer_rfm_base(w.customers, w.sales)


@query
def churn_labels(w: Warehouse) -> DataFrame:
    return churn.churn_labels(w.rfm_base)


@query
def churn_rate(w: Warehouse) -> DataFrame:
    return churn.churn_rate(churn.churn_labels(w.rfm_base))


@query
def recency_histogram(w: Warehouse) -> DataFrame:
    return churn.recency_histogram(w.rfm_base)


@query
def churn_model(w: Warehouse) -> DataFrame:
    return w.churn_model.quality()


@query
def churn_risk(w: Warehouse) -> DataFrame:
    return w.churn_model.risk()


@query
def churn_top_risk(w: Warehouse) -> DataFrame:
    return w.churn_model.top_risk()


@query
def churn_histogram(w: Warehouse) -> DataFrame:
    return w.churn_model.histogram()


@query
def feature_importance(w: Warehouse) -> DataFrame:
    return w.churn_model.importance()


@query
def product_score(w: Warehouse) -> DataFrame:
    return analytics.product_score(w.kpi_spread)


@query
def radar_metrics(w: Warehouse) -> DataFrame:
    """The compared products, each metric over the largest among them."""
    return analytics.radar_metrics(_compared(w))


@query
def radar_catalogue(w: Warehouse) -> DataFrame:
    return analytics.radar_metrics(w.product_kpi)


def _series(w: Warehouse) -> DataFrame:
    return forecast.monthly_series(w.sales, w.customers)


@query
def linear_forecast(w: Warehouse) -> DataFrame:
    return forecast.linear_forecast(_series(w))


@query
def category_forecast(w: Warehouse) -> DataFrame:
    return forecast.linear_forecast(forecast.product_series(w.sales, w.products, "category"))


@query
def product_forecast(w: Warehouse) -> DataFrame:
    return forecast.linear_forecast(forecast.product_series(w.sales, w.products, "product_id"))


@query
def holt_forecast(w: Warehouse) -> DataFrame:
    return forecast.holt_forecast(_series(w))


@query
def forecast_interval(w: Warehouse) -> DataFrame:
    return forecast.forecast_interval(_series(w))


@query
def holt_winters_forecast(w: Warehouse) -> DataFrame:
    return forecast.holt_winters_forecast(_series(w))


@query
def country_smoothing(w: Warehouse) -> DataFrame:
    return smoothing.smoothing_forecast(_series(w))


@query
def category_smoothing(w: Warehouse) -> DataFrame:
    return smoothing.smoothing_forecast(forecast.product_series(w.sales, w.products, "category"))


@query
def product_smoothing(w: Warehouse) -> DataFrame:
    return smoothing.smoothing_forecast(forecast.product_series(w.sales, w.products, "product_id"))


# --- search and conversation -----------------------------------------------------------------


def _asked(w: Warehouse) -> DataFrame:
    """The rows that ask: vectors whose id in the source is divisible by 50."""
    return w.vectors.where((F.col("id") - 1) % 50 == 0).select("id", "vec")


@query
def vector_search(w: Warehouse) -> DataFrame:
    return search.vector_search(w.vectors, _asked(w), w.reviews, w.mapping)


@query
def review_snippets(w: Warehouse) -> DataFrame:
    hits = search.vector_search(w.vectors, _asked(w), w.reviews, w.mapping)
    return search.review_snippets(hits, w.texts)


@query
def ann_search(w: Warehouse) -> DataFrame:
    return vector_index.search_index(w.vector_index, _asked(w), search.K)


@query
def ann_recall(w: Warehouse) -> DataFrame:
    """Per query how many exact hits there are to find, and whether the index finds nine tenths of those of all queries."""
    exact = search.top_k(w.vectors, _asked(w), search.K)
    found = materialize(search.search_recall(exact, vector_index.search_index(w.vector_index, _asked(w), search.K)), "recall")
    reached = found.agg((F.sum("found") >= 0.9 * F.sum("wanted")).alias("reached"))
    return with_scalars(found, reached).select("query_id", "wanted", "reached")


@query
def unindexed_reviews(w: Warehouse) -> DataFrame:
    return search.unindexed_reviews(w.reviews, w.vectors).select("review_id", "review_key")


@query
def embedding_upsert(w: Warehouse) -> DataFrame:
    table = search.embedding_upsert(w.vectors, w.reviews, w.texts)
    values = F.transform("vec", lambda x: F.round(x.cast("double"), 4) + 0)
    return table.where("origin = 'existing'").select("id", F.explode(values).alias("value"))


@query
def embedding_upsert_new(w: Warehouse) -> DataFrame:
    """The vectors of newly encoded reviews have length one, or zero without words."""
    table = search.embedding_upsert(w.vectors, w.reviews, w.texts).where("origin = 'new'")
    norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return table.select("id", F.size("vec").cast("long").alias("dims"), F.round(norm, 4).alias("norm"))


@query
def name_lookup(w: Warehouse) -> DataFrame:
    terms = w.products.select(F.explode(name_keywords(F.col("product_name"))).alias("keyword"))
    return reports.name_lookup(w.products, terms)


@query
def recent_messages(w: Warehouse) -> DataFrame:
    return conversation.recent_messages(w.messages, 3)


@query
def session_summary(w: Warehouse) -> DataFrame:
    return conversation.session_summary(w.messages, None)


@query
def latest_sessions(w: Warehouse) -> DataFrame:
    return conversation.session_summary(w.messages)


@query
def route_questions(w: Warehouse) -> DataFrame:
    return conversation.route_questions(w.messages)


@query
def route_analysis(w: Warehouse) -> DataFrame:
    return conversation.route_analyses(w.messages)


def _replies(w: Warehouse) -> DataFrame:
    """A reply per message in one of five written forms, as a language model gives them."""
    place, said = F.col("seq").cast("string"), F.coalesce("content", F.lit(""))
    quoted = F.concat(F.lit("SELECT role FROM conversations WHERE text <> '"), F.replace(said, F.lit("'"), F.lit("''")), F.lit("' AND turn = "), place)
    forms = [
        F.concat(F.lit("```json\n"), F.to_json(F.struct(quoted.alias("sql"), F.lit("r").alias("reasoning"))), F.lit("\n```")),
        F.concat(said, F.lit(" SELECT role FROM conversations LIMIT "), place, F.lit(" as asked")),
        F.to_json(F.struct(said.alias("reasoning"), F.lit("SELECT ...").alias("sql"))),
        said,
        F.to_json(F.struct(said.alias("answer"), F.concat(F.lit("DROP TABLE t"), place, F.lit(" FROM x")).alias("sql"))),
    ]
    reply = forms[-1]
    for i, form in enumerate(forms[:-1]):
        reply = F.when(F.col("seq") % len(forms) == i, form).otherwise(reply)
    return w.messages.select("session_id", "seq", F.col("content").alias("question"), reply.alias("reply"))


@query
def extract_sql(w: Warehouse) -> DataFrame:
    return conversation.extract_sql(_replies(w))


@query
def flag_unsafe_sql(w: Warehouse) -> DataFrame:
    return conversation.flag_unsafe_sql(_replies(w), "reply").select("session_id", "seq", "unsafe")
