"""Product and customer marts.

``product_kpi`` and ``customer_kpi`` reproduce the joins of sales and reviews as
one row set, in which each sales line repeats per review of its product and
vice versa. The repeats are computed as weights on pre-aggregated facts, so no
line is ever multiplied. The ``_exact`` marts give the plain sums.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillframe.functions.ordering import with_scalars
from tillframe.functions.skew import join_keyed, join_totals

# Status names and their limits.
CRITICAL, WATCH, FINE = "CRITIQUE", "A_SURVEILLER", "OK"
CRITICAL_RATING, CRITICAL_QUANTITY, WATCH_RATING = "3.0", 50, "3.5"

_WIDE = "decimal(28,2)"


def money(column: Column | str) -> Column:
    """Totals leave the marts as doubles with two decimals."""
    return F.round(F.col(column) if isinstance(column, str) else column, 2).cast("double")


def mean2(total: Column, count: Column) -> Column:
    """A decimal mean, half-up to two places; null without rows."""
    return F.round(total.cast("decimal(28,6)") / F.when(count > 0, count).cast("decimal(20,0)"), 2)


def sales_per_product(sales: DataFrame) -> DataFrame:
    return sales.groupBy("product_id").agg(
        F.sum("revenue").alias("revenue"),
        F.sum("margin").alias("margin"),
        F.sum("quantity").alias("quantity"),
        F.count("*").alias("lines"),
    )


def reviews_per_code(reviews: DataFrame) -> DataFrame:
    def having(label: str) -> Column:
        return F.count_if(F.col("sentiment") == label)

    return reviews.where(F.col("review_code").isNotNull()).groupBy("review_code").agg(
        F.sum("rating").alias("rating_sum"),
        F.count("rating").alias("ratings"),
        F.count("*").alias("reviews"),
        having("positive").alias("positive"),
        having("negative").alias("negative"),
        having("neutral").alias("neutral"),
    )


def _mapped(mapping: DataFrame, sales: DataFrame, reviews: DataFrame) -> DataFrame:
    return _mapped_facts(mapping, sales_per_product(sales), reviews_per_code(reviews))


def _mapped_facts(mapping: DataFrame, per_product: DataFrame, per_code: DataFrame) -> DataFrame:
    """One row per mapping with the totals of both facts, zero where there are none."""
    keyed = mapping.select("product_id", F.col("golden_name").alias("product_name"), "category", "review_code")
    joined = keyed.join(per_product, "product_id", "left").join(per_code, "review_code", "left")
    return joined.fillna(0, ["quantity", "lines", "ratings", "reviews", "positive", "negative", "neutral"])


def _kpi(rows: DataFrame, per_line: Column, per_review: Column) -> DataFrame:
    """Sales totals weighted by ``per_line`` and review counts by ``per_review``."""

    def total(name: str) -> Column:
        value = F.col(name).cast(_WIDE) * per_line.cast("decimal(20,0)")
        return money(F.coalesce(value, F.lit(0).cast(_WIDE)))

    return rows.select(
        "product_id",
        "product_name",
        "category",
        total("revenue").alias("revenue"),
        total("margin").alias("margin"),
        (F.col("quantity") * per_line).alias("quantity"),
        mean2(F.col("rating_sum"), F.col("ratings")).cast("double").alias("avg_rating"),
        (F.col("reviews") * per_review).alias("reviews"),
        (F.col("positive") * per_review).alias("positive"),
        (F.col("negative") * per_review).alias("negative"),
        (F.col("neutral") * per_review).alias("neutral"),
    )


def product_kpi(mapping: DataFrame, sales: DataFrame, reviews: DataFrame) -> DataFrame:
    return product_kpi_of_facts(mapping, sales_per_product(sales), reviews_per_code(reviews))


def product_kpi_of_facts(mapping: DataFrame, per_product: DataFrame, per_code: DataFrame) -> DataFrame:
    """``product_kpi`` from the totals of ``sales_per_product`` and ``reviews_per_code``."""
    rows = _mapped_facts(mapping, per_product, per_code)
    return _kpi(rows, F.greatest(F.col("reviews"), F.lit(1)), F.greatest(F.col("lines"), F.lit(1)))


def product_kpi_exact(mapping: DataFrame, sales: DataFrame, reviews: DataFrame) -> DataFrame:
    return _kpi(_mapped(mapping, sales, reviews), F.lit(1), F.lit(1))


def _product_reviews(mapping: DataFrame, per_code: DataFrame) -> DataFrame:
    """Review totals per product; one row per mapping, zero without reviews."""
    return (
        mapping.select("product_id", "review_code")
        .join(per_code, "review_code", "left")
        .select("product_id", "rating_sum", F.coalesce("ratings", F.lit(0)).alias("ratings"), F.coalesce("reviews", F.lit(0)).alias("reviews"))
    )


def _weighted_lines(sales: DataFrame, weights: DataFrame, mapping_rows: int | None) -> DataFrame:
    """Sales per customer and product, which is as far as review weights differ, with their weights."""
    totals = [F.sum("revenue").alias("revenue"), F.count("*").alias("lines")]
    rows = sales.select("customer_id", "product_id", "revenue")
    return join_totals(rows, ["customer_id", "product_id"], totals, weights, "product_id", mapping_rows)


def _orders(sales: DataFrame) -> DataFrame:
    return sales.groupBy("customer_id").agg(F.count_distinct("invoice_no").alias("orders"))


def customer_kpi(
    customers: DataFrame,
    sales: DataFrame,
    mapping: DataFrame,
    reviews: DataFrame,
    mapping_rows: int | None = None,
) -> DataFrame:
    weights = _product_reviews(mapping, reviews_per_code(reviews))
    return _weighted_kpi(customers, _weighted_lines(sales, weights, mapping_rows), _orders(sales))


def customer_kpi_of_facts(
    customers: DataFrame,
    customer_lines: DataFrame,
    orders: DataFrame,
    mapping: DataFrame,
    per_code: DataFrame,
    mapping_rows: int | None = None,
) -> DataFrame:
    """``customer_kpi`` from totals: revenue and lines per customer and product, orders per customer, reviews per code."""
    weights = _product_reviews(mapping, per_code)
    return _weighted_kpi(customers, join_keyed(customer_lines, weights, "product_id", "left", keyed_rows=mapping_rows), orders)


def _weighted_kpi(customers: DataFrame, lines: DataFrame, orders: DataFrame) -> DataFrame:
    weight = F.greatest(F.coalesce("reviews", F.lit(0)), F.lit(1))
    totals = lines.groupBy("customer_id").agg(
        F.count("product_id").alias("products"),
        F.sum(F.col("revenue").cast(_WIDE) * weight.cast("decimal(20,0)")).alias("revenue"),
        F.sum(F.col("lines") * weight).alias("joined_lines"),
        F.sum(F.col("rating_sum").cast(_WIDE) * F.col("lines").cast("decimal(20,0)")).alias("rating_sum"),
        F.sum(F.col("ratings") * F.col("lines")).alias("ratings"),
        F.sum(F.coalesce(F.col("reviews"), F.lit(0)) * F.col("lines")).alias("reviews"),
    )
    return _customer_rows(customers, totals, orders)


def customer_kpi_exact(
    customers: DataFrame,
    sales: DataFrame,
    mapping: DataFrame,
    reviews: DataFrame,
    mapping_rows: int | None = None,
) -> DataFrame:
    """True revenue; ratings and reviews are those of the distinct products bought."""
    weights = _product_reviews(mapping, reviews_per_code(reviews))
    lines = _weighted_lines(sales, weights, mapping_rows)
    totals = lines.groupBy("customer_id").agg(
        F.count("product_id").alias("products"),
        F.sum("revenue").alias("revenue"),
        F.sum("lines").alias("joined_lines"),
        F.sum("rating_sum").alias("rating_sum"),
        F.sum("ratings").alias("ratings"),
        F.sum(F.coalesce(F.col("reviews"), F.lit(0))).alias("reviews"),
    )
    return _customer_rows(customers, totals, _orders(sales))


def _customer_rows(customers: DataFrame, totals: DataFrame, orders: DataFrame) -> DataFrame:
    return (
        customers.join(totals, "customer_id", "left")
        .join(orders, "customer_id", "left")
        .select(
            "customer_id",
            "name",
            "country",
            F.coalesce("orders", F.lit(0)).alias("orders"),
            F.coalesce("products", F.lit(0)).alias("products"),
            money("revenue").alias("revenue"),
            mean2(F.col("revenue"), F.col("joined_lines")).cast("double").alias("avg_basket"),
            mean2(F.col("rating_sum"), F.col("ratings")).cast("double").alias("avg_rating"),
            F.coalesce("reviews", F.lit(0)).alias("reviews"),
        )
    )


def alert_status(rating: Column, quantity: Column) -> Column:
    value = rating.cast("decimal(10,2)")
    return (
        F.when((value < F.lit(CRITICAL_RATING).cast("decimal(3,1)")) & (quantity > CRITICAL_QUANTITY), CRITICAL)
        .when(value < F.lit(WATCH_RATING).cast("decimal(3,1)"), WATCH)
        .otherwise(FINE)
    )


def product_alerts(kpi: DataFrame) -> DataFrame:
    """Reviewed products with their status, lowest rating first."""
    return (
        kpi.where(F.col("reviews") > 0)
        .select(
            "product_id",
            "product_name",
            "category",
            "revenue",
            "avg_rating",
            "reviews",
            "negative",
            "quantity",
            alert_status(F.col("avg_rating"), F.col("quantity")).alias("status"),
        )
        .orderBy(F.asc_nulls_last("avg_rating"), "product_id")
    )


def data_quality_summary(
    products: DataFrame, customers: DataFrame, mapping: DataFrame, sales: DataFrame, reviews: DataFrame
) -> DataFrame:
    """One row of counts, each from one aggregate over its table."""
    linked = reviews.where(F.col("review_code").isNotNull()).select("review_code").distinct()
    covered = linked.join(mapping.select("review_code").distinct(), "review_code", "left_semi")
    parts = [
        products.agg(F.count("*").alias("erp_products")),
        mapping.agg(F.count("*").alias("golden_records"), F.count("*").alias("mappings")),
        reviews.agg(
            F.count_distinct("review_code").alias("reviewed_codes"),
            F.count("*").alias("reviews"),
            F.count("review_code").alias("linked_reviews"),
        ),
        sales.agg(F.count_distinct("invoice_no").alias("invoices")),
        customers.agg(F.count("*").alias("customers")),
        covered.agg(F.count("*").alias("covered_codes")),
    ]
    row = parts[0]
    for part in parts[1:]:
        row = with_scalars(row, part)
    pct = F.col("covered_codes").cast("decimal(20,0)") * 100 / F.greatest("mappings", F.lit(1)).cast("decimal(20,0)")
    return row.withColumn("coverage_pct", F.round(pct, 1).cast("double")).drop("covered_codes")


# The strategies counted, the last one never being written.
COUNTED_STRATEGIES = ("hard", "fuzzy", "tfidf", "sbert")


def match_strategy_counts(mapping: DataFrame) -> DataFrame:
    return mapping.agg(
        F.count("*").alias("mappings"),
        *[F.count_if(F.col("match_strategy") == s).alias(f"{s}_matches") for s in COUNTED_STRATEGIES],
    )


def orphans(child: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Child rows whose non-null key has no parent."""
    known = parent.select(F.col(parent_key).alias(key)).distinct()
    return child.where(F.col(key).isNotNull()).join(known, key, "left_anti")


def clear_orphans(child: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Child rows with the key set to null where it has no parent."""
    known = parent.select(F.col(parent_key).alias(key)).distinct().withColumn("_known", F.lit(True))
    joined = child.join(known, key, "left")
    return joined.withColumn(key, F.when(F.col("_known"), F.col(key))).select(*child.columns)


def fk_orphans(references: list[tuple[str, DataFrame, str, DataFrame, str]]) -> DataFrame:
    """Orphans per reference (name, child, key, parent, parent key); key counts meet first."""
    report = None
    for name, child, key, parent, parent_key in references:
        per_key = child.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"))
        row = orphans(per_key, key, parent, parent_key).agg(
            F.lit(name).alias("reference"),
            F.coalesce(F.sum("n"), F.lit(0)).alias("orphan_rows"),
            F.count("*").alias("orphan_keys"),
        )
        report = row if report is None else report.unionByName(row)
    return report


def table_profile(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows and columns of each table."""
    report = None
    for name, df in tables.items():
        row = df.agg(
            F.lit(name).alias("table_name"), F.count("*").alias("rows"), F.lit(len(df.columns)).cast("long").alias("columns")
        )
        report = row if report is None else report.unionByName(row)
    return report
