"""Business questions over the marts and the facts."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillframe.functions.ordering import with_position, with_scalars
from tillframe.functions.skew import join_keyed
from tillframe.functions.text import match_keywords, name_keywords
from tillframe.operators.marts import FINE, mean2, money, reviews_per_code
from tillframe.sources.storage import materialize

SORT_KEYS = {
    "revenue": "revenue",
    "rating": "avg_rating",
    "quantity": "quantity",
    "negative": "negative",
}


def product_listing(
    kpi: DataFrame,
    alerts: DataFrame,
    category: str | None = None,
    status: str | None = None,
    sort_by: str = "revenue",
    n: int = 25,
) -> DataFrame:
    """The first ``n`` products; those without reviews show as fine but fail a status filter."""
    rows = kpi if category is None else kpi.where(F.col("category") == category)
    how = "left"
    flags = alerts.select("product_id", "status")
    if status is not None:
        flags, how = flags.where(F.col("status") == status), "inner"
    rows = rows.join(flags, "product_id", how)
    return (
        rows.orderBy(F.desc_nulls_first(SORT_KEYS[sort_by]), "product_id")
        .limit(n)
        .select(
            "product_id",
            "product_name",
            "category",
            "revenue",
            "quantity",
            F.round(F.col("avg_rating").cast("decimal(10,2)"), 1).cast("double").alias("rating"),
            "reviews",
            "positive",
            "negative",
            F.coalesce("status", F.lit(FINE)).alias("status"),
        )
    )


def dashboard_totals(kpi: DataFrame) -> DataFrame:
    return kpi.agg(
        money(F.sum(F.col("revenue").cast("decimal(28,2)"))).alias("revenue"),
        mean2(F.sum(F.col("avg_rating").cast("decimal(28,2)")), F.count("avg_rating")).cast("double").alias("avg_rating"),
        F.sum("reviews").alias("reviews"),
        F.count("*").alias("products"),
    )


def revenue_by_category(kpi: DataFrame) -> DataFrame:
    return (
        kpi.groupBy("category")
        .agg(money(F.sum(F.col("revenue").cast("decimal(28,2)"))).alias("revenue"))
        .orderBy(F.desc("revenue"), "category")
    )


def open_alerts(alerts: DataFrame, n: int = 10) -> DataFrame:
    rows = alerts.where(F.col("status") != FINE)
    return rows.orderBy("avg_rating", "product_id").limit(n).select(
        "product_id", "product_name", "avg_rating", "negative", "status"
    )


CRITICAL_COLUMNS = ("product_id", "product_name", "category", "avg_rating", "reviews", "negative", "revenue")


def critical_products(alerts: DataFrame, status: str = "CRITIQUE") -> DataFrame:
    return alerts.where(F.col("status") == status).select(*CRITICAL_COLUMNS).orderBy("avg_rating", "product_id")


def critical_by_strategy(alerts: dict[str, DataFrame], status: str = "CRITIQUE") -> DataFrame:
    """The critical products under each strategy of the mapping, with its name: ``alerts`` maps one to the other."""
    found = [critical_products(rows, status).withColumn("strategy", F.lit(name)) for name, rows in alerts.items()]
    return reduce(DataFrame.unionByName, found).orderBy("avg_rating", "product_id", "strategy")


def alert_messages(critical: DataFrame) -> DataFrame:
    """One notification text per critical product, and strategy where ``critical`` names them."""
    # Fixed value: the form of the message.
    text = F.format_string(
        "%s [%s] Note : %s/5 | %d avis négatifs / %d total | CA : %s EUR",
        "product_name",
        "category",
        F.col("avg_rating").cast("decimal(10,2)").cast("string"),
        "negative",
        "reviews",
        F.format_number(F.col("revenue").cast("decimal(28,2)"), 0),
    )
    return critical.select("product_id", text.alias("message"), *[c for c in critical.columns if c == "strategy"])


def worst_rated_products(alerts: DataFrame, n: int = 10) -> DataFrame:
    rows = alerts.where(F.col("status").isin("CRITIQUE", "A_SURVEILLER"))
    return rows.orderBy("avg_rating", "product_id").limit(n).select(
        "product_id", "product_name", "avg_rating", "negative", "status"
    )


def best_sellers(kpi: DataFrame, n: int = 10) -> DataFrame:
    return kpi.orderBy(F.desc("revenue"), "product_id").limit(n).select(
        "product_id", "product_name", "category", "revenue", "quantity", "avg_rating"
    )


def best_rated_products(kpi: DataFrame, n: int = 10) -> DataFrame:
    """Best ratings first; products without a rating come before all others."""
    return kpi.orderBy(F.desc_nulls_first("avg_rating"), "product_id").limit(n).select(
        "product_id", "product_name", "avg_rating", "reviews", "positive", "negative"
    )


def top_customers(customer_kpi: DataFrame, n: int = 10) -> DataFrame:
    return customer_kpi.orderBy(F.desc_nulls_first("revenue"), "customer_id").limit(n).select(
        "customer_id", "name", "country", "orders", "revenue"
    )


def customer_satisfaction(
    customer_kpi: DataFrame,
    sales: DataFrame,
    mapping: DataFrame,
    reviews: DataFrame,
    n: int | None = 200,
    mapping_rows: int | None = None,
) -> DataFrame:
    """Customers with a rated purchase and their mean rating per line and review."""
    rated = mapping.select("product_id", "review_code").join(reviews_per_code(reviews), "review_code")
    bought = sales.groupBy("customer_id", "product_id").agg(F.count("*").alias("lines"))
    lines = join_keyed(bought, rated.select("product_id", "rating_sum", "ratings"), "product_id", "inner", keyed_rows=mapping_rows)
    means = lines.groupBy("customer_id").agg(
        F.sum(F.col("rating_sum").cast("decimal(28,2)") * F.col("lines").cast("decimal(20,0)")).alias("s"),
        F.sum(F.col("ratings") * F.col("lines")).alias("c"),
    )
    rows = customer_kpi.join(means, "customer_id").select(
        "customer_id",
        "name",
        "country",
        "revenue",
        "orders",
        "avg_basket",
        F.coalesce(mean2(F.col("s"), F.col("c")).cast("double"), F.lit(0.0)).alias("avg_rating"),
    )
    return rows if n is None else rows.orderBy(F.desc_nulls_first("revenue"), "customer_id").limit(n)


def category_list(products: DataFrame) -> DataFrame:
    return products.select("category").distinct().orderBy("category")


def product_sheet_sales(sales: DataFrame) -> DataFrame:
    """Per product: revenue, quantity, invoices and lines.

    Lines are first reduced per product and invoice, so that a single aggregate
    per product also gives the distinct invoices.
    """
    per_invoice = sales.groupBy("product_id", "invoice_no").agg(
        F.sum("revenue").alias("revenue"), F.sum("quantity").alias("quantity"), F.count("*").alias("lines")
    )
    return per_invoice.groupBy("product_id").agg(
        money(F.sum("revenue")).alias("revenue"),
        F.sum("quantity").alias("quantity"),
        F.count("invoice_no").alias("invoices"),
        F.sum("lines").alias("lines"),
    )


def product_sheet_reviews(mapping: DataFrame, reviews: DataFrame) -> DataFrame:
    return (
        mapping.select("product_id", "review_code")
        .join(reviews_per_code(reviews), "review_code")
        .select("product_id", mean2(F.col("rating_sum"), F.col("ratings")).cast("double").alias("avg_rating"), "reviews")
    )


def period_start(granularity: str) -> Column:
    return F.date_trunc(granularity, F.col("invoice_ts").cast("timestamp")).cast("timestamp_ntz")


def product_monthly_revenue(sales: DataFrame) -> DataFrame:
    return sales.groupBy("product_id", period_start("month").alias("month")).agg(money(F.sum("revenue")).alias("revenue"))


def monthly_revenue(sales: DataFrame) -> DataFrame:
    return (
        sales.groupBy(period_start("month").alias("month")).agg(money(F.sum("revenue")).alias("revenue")).orderBy("month")
    )


def in_range(sales: DataFrame, start: str, end: str) -> DataFrame:
    """Lines from ``start`` to ``end``, both as midnight: the last day counts at 00:00 only."""
    if start >= end:
        raise ValueError("start must lie before end")
    return sales.where(
        F.col("invoice_ts").between(F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz"))
    )


def revenue_by_period(sales: DataFrame, granularity: str, start: str, end: str) -> DataFrame:
    """Revenue, quantity and distinct invoices per month, quarter or year."""
    if granularity not in ("month", "quarter", "year"):
        raise ValueError(f"unknown granularity: {granularity}")
    lines = in_range(sales, start, end)
    per_invoice = lines.groupBy(period_start(granularity).alias("period"), "invoice_no").agg(
        F.sum("revenue").alias("revenue"), F.sum("quantity").alias("quantity")
    )
    return (
        per_invoice.groupBy("period")
        .agg(
            money(F.sum("revenue")).alias("revenue"),
            F.sum("quantity").alias("quantity"),
            F.count("invoice_no").alias("invoices"),
        )
        .orderBy("period")
    )


def period_totals(periods: DataFrame) -> DataFrame:
    return periods.agg(
        money(F.sum(F.col("revenue").cast("decimal(28,2)"))).alias("revenue"),
        F.sum("quantity").alias("quantity"),
        F.sum("invoices").alias("invoices"),
    )


def period_top_products(
    sales: DataFrame, mapping: DataFrame, start: str, end: str, n: int = 10, mapping_rows: int | None = None
) -> DataFrame:
    per_product = in_range(sales, start, end).groupBy("product_id").agg(
        F.sum("revenue").alias("revenue"), F.sum("quantity").alias("quantity")
    )
    named = mapping.select("product_id", "golden_name", "category")
    return (
        per_product.join(named, "product_id")
        .groupBy("golden_name", "category")
        .agg(money(F.sum("revenue")).alias("revenue"), F.sum("quantity").alias("quantity"))
        .orderBy(F.desc("revenue"), "golden_name", "category")
        .limit(n)
    )


def sales_by_country(sales: DataFrame, customers: DataFrame) -> DataFrame:
    """Distinct invoices, revenue and buying customers per country."""
    lines = sales.groupBy("customer_id", "invoice_no").agg(F.sum("revenue").alias("revenue"))
    located = lines.join(customers.select("customer_id", "country"), "customer_id")
    totals = located.groupBy("country").agg(
        F.count_distinct("invoice_no").alias("invoices"),
        money(F.sum("revenue")).alias("revenue"),
        F.count_distinct("customer_id").alias("customers"),
    )
    return totals.orderBy(F.desc("revenue"), "country")


def geo_totals(by_country: DataFrame) -> DataFrame:
    return by_country.agg(
        F.count("country").alias("countries"),
        money(F.sum(F.col("revenue").cast("decimal(28,2)"))).alias("revenue"),
        F.sum("customers").alias("customers"),
    )


COMPARED = ("category", "revenue", "margin", "quantity", "avg_rating", "reviews", "positive", "negative")


def product_comparison(kpi: DataFrame, product_ids: Sequence[str] | DataFrame) -> DataFrame:
    """KPI rows of the chosen products: a list of ids or a table of them."""
    if isinstance(product_ids, DataFrame):
        rows = kpi.join(product_ids.select("product_id").distinct(), "product_id", "left_semi")
    else:
        rows = kpi.where(F.col("product_id").isin(list(product_ids)))
    return rows.select("product_id", "product_name", *COMPARED)


def comparison_transposed(comparison: DataFrame, n: int = 4) -> DataFrame:
    """Metrics as rows and up to ``n`` products as columns, all as text.

    The products become ``product_1`` to ``product_n`` in the order of their ids.
    More than ``n`` products are an error.
    """
    if comparison.limit(n + 1).count() > n:
        raise ValueError(f"more than {n} products to compare")

    def text(c: str) -> Column:
        return F.col(c) if c == "category" else F.col(c).cast("decimal(28,2)").cast("string")

    chosen = comparison.orderBy("product_id").limit(n)
    numbered = chosen.withColumn("place", F.row_number().over(Window.orderBy("product_id")))  # n rows
    texts = numbered.select("place", *[text(c).alias(c) for c in COMPARED])
    long = texts.unpivot("place", list(COMPARED), "metric", "value")
    wide = long.groupBy("metric").pivot("place", list(range(1, n + 1))).agg(F.first("value"))
    return wide.select("metric", *[F.col(f"`{i}`").alias(f"product_{i}") for i in range(1, n + 1)])


def mapping_extract(mapping: DataFrame, n: int = 20) -> DataFrame:
    return mapping.orderBy("mapping_id").limit(n).select(
        "mapping_id", "product_id", "product_name", "review_code", "category", "golden_name"
    )


def coverage_by_category(mapping: DataFrame, reviews: DataFrame) -> DataFrame:
    reviewed = reviews.select("review_code").where(F.col("review_code").isNotNull()).distinct().withColumn(
        "reviewed_code", F.col("review_code")
    )
    products = mapping.groupBy("category").agg(F.count_distinct("product_id").alias("erp_products"))
    codes = mapping.select("category", "review_code").distinct().join(reviewed, "review_code", "left")
    covered = codes.groupBy("category").agg(F.count("reviewed_code").alias("reviewed_products"))
    pct = F.col("reviewed_products").cast("decimal(20,0)") * 100 / F.nullif("erp_products", F.lit(0)).cast("decimal(20,0)")
    return (
        products.alias("p")
        .join(covered.alias("c"), F.col("p.category").eqNullSafe(F.col("c.category")))
        .select("p.category", "erp_products", "reviewed_products")
        .withColumn("coverage_pct", F.round(pct, 1).cast("double"))
        .orderBy(F.desc_nulls_first("coverage_pct"), "category")
    )


# --- reviews of a product, with a search by name where the mapping gives none --------


def _unmapped_keyword_sets(products: DataFrame, mapping: DataFrame, reviews: DataFrame) -> DataFrame:
    """Products without mapped reviews and the keywords of their names."""
    reached = mapping.join(reviews.select("review_code").distinct(), "review_code", "left_semi").select("product_id")
    missing = products.select("product_id", "product_name").join(reached, "product_id", "left_anti")
    return missing.select("product_id", _keyword_set(F.col("product_name")).alias("keywords"))


def _keyword_set(name: Column) -> Column:
    return F.array_sort(F.array_distinct(name_keywords(name)))


def _reached(texts: DataFrame, sets: DataFrame) -> DataFrame:
    """(keywords, id): the reviews that contain any keyword of a set, each once per distinct set."""
    words = sets.select("keywords").distinct().select("keywords", F.explode("keywords").alias("keyword"))
    return match_keywords(texts, words.select("keyword")).join(words, "keyword").select("keywords", "id").distinct()


def review_keyword_search(texts: DataFrame, names: DataFrame) -> DataFrame:
    """Reviews per product name that contain one of its keywords.

    ``texts`` has ``id`` and ``text``; ``names`` has ``product_name``.
    """
    sets = names.select("product_name").distinct().withColumn("keywords", _keyword_set(F.col("product_name")))
    counts = _reached(texts, sets).groupBy("keywords").agg(F.count("*").alias("n"))
    return sets.join(counts, "keywords").select("product_name", F.col("n").alias("matching_reviews"))


def rating_distribution(products: DataFrame, mapping: DataFrame, reviews: DataFrame, texts: DataFrame) -> DataFrame:
    """Reviews per product and rating, by mapping or else by keywords of the name.

    ``reviews`` has ``review_key``; ``texts`` has ``id`` (that key) and ``text``.
    """
    per_code = reviews.where(F.col("review_code").isNotNull()).groupBy("review_code", "rating").agg(F.count("*").alias("reviews"))
    mapped = mapping.select("product_id", "review_code").join(per_code, "review_code").select(
        "product_id", F.col("rating").cast("double").alias("rating"), "reviews", F.lit("mapping").alias("source")
    )
    missing = materialize(_unmapped_keyword_sets(products, mapping, reviews), "unmapped")
    found = _reached(texts, missing).withColumnRenamed("id", "review_key")
    hits = found.join(reviews.select("review_key", "rating"), "review_key").groupBy("keywords", "rating").agg(F.count("*").alias("n"))
    searched = missing.join(hits, "keywords").select(
        "product_id",
        F.col("rating").cast("double").alias("rating"),
        F.col("n").alias("reviews"),
        F.lit("keywords").alias("source"),
    )
    return mapped.unionByName(searched)


def _first_rows(df: DataFrame, key: Sequence[str], order: Sequence[Column | str], n: int) -> DataFrame:
    """The first ``n`` rows per key; map tasks already keep only ``n`` each."""
    window = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("place", F.row_number().over(window)).where(F.col("place") <= n)


def latest_reviews(
    products: DataFrame, mapping: DataFrame, reviews: DataFrame, texts: DataFrame, n: int = 3
) -> DataFrame:
    """Per product ``n`` reviews: newest mapped ones, else best keyword hits, else newest of all."""
    facts = reviews.select("review_key", "review_id", "review_code", "rating", "sentiment", "review_ts")
    newest = [F.desc("review_ts"), "review_id"]
    per_code = _first_rows(facts.where(F.col("review_code").isNotNull()), ["review_code"], newest, n)
    columns = ["product_id", "place", "review_id", "rating", "sentiment", "source"]
    mapped = mapping.select("product_id", "review_code").join(per_code, "review_code").withColumn("source", F.lit("mapping"))

    missing = materialize(_unmapped_keyword_sets(products, mapping, reviews), "unmapped")
    sets = missing.select("keywords").distinct().withColumn("keyword", F.explode("keywords"))
    found = match_keywords(texts, sets.select("keyword")).withColumnRenamed("id", "review_key")
    best = [F.desc("rating"), "review_id"]
    per_word = _first_rows(found.join(facts, "review_key"), ["keyword"], best, n).drop("place")
    per_set = sets.join(per_word, "keyword").drop("keyword").distinct()
    searched = missing.join(_first_rows(per_set, ["keywords"], best, n), "keywords").withColumn("source", F.lit("keywords"))

    rest = missing.join(per_set.select("keywords").distinct(), "keywords", "left_anti").select("product_id")
    top = facts.orderBy(*newest).limit(n)
    numbered = top.withColumn("place", F.row_number().over(Window.orderBy(*newest)))  # n rows
    overall = with_scalars(rest, numbered).withColumn("source", F.lit("overall"))
    rows = mapped.select(columns).unionByName(searched.select(columns)).unionByName(overall.select(columns))
    return rows.withColumn("rating", F.col("rating").cast("double"))


def name_lookup(names: DataFrame, terms: DataFrame) -> DataFrame:
    """Products whose name contains a search term, ignoring case: term, name and product count.

    ``names`` has ``product_name``; ``terms`` has ``keyword``.
    """
    counted = names.groupBy("product_name").agg(F.count("*").alias("products"))
    texts = counted.select(F.col("product_name").alias("id"), F.col("product_name").alias("text"))
    found = match_keywords(texts, terms).withColumnRenamed("id", "product_name")
    return found.join(counted, "product_name").select(F.col("keyword").alias("term"), "product_name", "products")
