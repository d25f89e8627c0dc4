"""Cleaning of invoice lines and reviews, and the tables drawn from them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillframe.functions.ordering import with_position
from tillframe.functions.rules import erp_category, mdm_category

# Header of the invoice file and the names used from there on.
SALES_COLUMNS = {
    "Invoice": "invoice_no",
    "StockCode": "product_id",
    "Description": "description",
    "Quantity": "quantity",
    "InvoiceDate": "invoice_ts",
    "Price": "unit_price",
    "Customer ID": "customer_id",
    "Country": "country",
}
MONEY = "decimal(12,2)"
REVIEW_EPOCH = "2024-01-01"
REVIEW_DAYS = 549
EXCERPT_CHARS = 500
DATE_FORMATS = ("M/d/yyyy H:mm", "M/d/yyyy H:mm:ss", "M/d/yyyy", "yyyy/M/d H:mm", "yyyy/M/d")


def rename_sales(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed(SALES_COLUMNS)


def sample_n(df: DataFrame, n: int, seed: int = 42, key: list[str] | None = None) -> DataFrame:
    """Exactly ``n`` rows picked by a seeded hash of ``key`` (default: all columns); all rows when ``n`` is 0.

    The pick depends on the rows alone, not on how they are partitioned.
    """
    if not n:
        return df
    total = df.count()
    if total <= n:
        return df
    hashed = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in key or df.columns]
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *hashed))
    # The n smallest digests almost surely lie below this cut, which keeps the sort small.
    share = (n + 6 * n**0.5 + 20) / total
    below = df.where(digest < F.lit(f"{int(share * 16**12):012x}")) if share < 1 else df
    if below.limit(n).count() < n:
        below = df
    return below.orderBy(digest, *df.columns).limit(n)


def invoice_timestamp(df: DataFrame, column: str = "invoice_ts", formats: Sequence[str] = DATE_FORMATS) -> Column:
    """The column as a zone-less timestamp; text that is not a date gives null.

    Text is read as an ISO date first, then in each of ``formats``.
    """
    value = F.col(column)
    if dict(df.dtypes)[column] == "string":
        text = strip(value)
        value = F.coalesce(F.try_to_timestamp(text), *[F.try_to_timestamp(text, F.lit(f)) for f in formats])
    return value.cast("timestamp_ntz")


def strip(text: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def margin_rate(line_key: Column) -> Column:
    """A rate from 0.20 to 0.45 in 1,001 steps, fixed by the line key."""
    step = F.pmod(line_key, F.lit(1001)).cast("decimal(4,0)")
    return F.lit("0.20").cast("decimal(3,2)") + step * F.lit("0.00025").cast("decimal(6,5)")


def clean_sales(raw: DataFrame) -> DataFrame:
    """Valid lines with revenue and margin.

    Drops cancelled invoices, non-positive quantities and prices, blank customers,
    unreadable dates and lines whose revenue rounds to zero. A line without an
    invoice number is not cancelled.
    """
    if "line_key" not in raw.columns:
        raw = raw.withColumn("line_key", F.xxhash64(*raw.columns))
    valid = raw.where(
        ~F.coalesce(F.col("invoice_no"), F.lit("")).startswith("C")
        & (F.col("quantity") > 0)
        & (F.col("unit_price") > 0)
        & F.col("customer_id").isNotNull()
        & (strip(F.col("customer_id")) != "")
    ).withColumn("invoice_ts", invoice_timestamp(raw))
    amount = F.col("quantity").cast("decimal(10,0)") * F.col("unit_price").cast("decimal(14,4)")
    priced = (
        valid.where(F.col("invoice_ts").isNotNull())
        .withColumn("revenue", F.bround(amount, 2).cast(MONEY))
        .where(F.col("revenue") > 0)
    )
    return priced.select(
        "invoice_no",
        "product_id",
        "description",
        F.col("quantity").cast("long").alias("quantity"),
        F.col("unit_price").cast("decimal(14,4)").alias("unit_price"),
        "revenue",
        F.round(F.col("revenue") * margin_rate(F.col("line_key")), 2).cast(MONEY).alias("margin"),
        "invoice_ts",
        "customer_id",
        "country",
    )


def top_products(sales: DataFrame, n: int = 0) -> DataFrame:
    """Products with name, quantity and category, best sellers first.

    A code with several names keeps its alphabetically first name, with the
    quantity sold under that name only. ``n=0`` keeps all products.
    """
    per_name = (
        sales.where(F.col("description").isNotNull())
        .groupBy("product_id", "description")
        .agg(F.sum("quantity").alias("quantity"))
    )
    first = per_name.groupBy("product_id").agg(F.min(F.struct("description", "quantity")).alias("f"))
    products = first.select(
        "product_id",
        F.col("f.description").alias("product_name"),
        F.col("f.quantity").alias("quantity"),
        erp_category(F.col("f.description")).alias("category"),
    )
    return products.orderBy(F.desc("quantity"), "product_id").limit(n) if n else products


def ranked_products(sales: DataFrame, n: int = 0) -> DataFrame:
    """Products with ``idx``, their 0-based place among the best sellers."""
    return with_position(top_products(sales, n), [F.desc("quantity"), F.asc("product_id")], "idx")


def distinct_customers(sales: DataFrame) -> DataFrame:
    """One row per customer with the country of the earliest invoice.

    The first step keeps one row per customer and country with a plain minimum.
    """
    seen = sales.groupBy("customer_id", "country").agg(F.min("invoice_ts").alias("since"))
    first = seen.groupBy("customer_id").agg(F.min(F.struct("since", "country"))["country"].alias("country"))
    return first.select("customer_id", F.concat(F.lit("Client_"), "customer_id").alias("name"), "country")


def categorize_products(products: DataFrame, name: str = "product_name") -> DataFrame:
    return products.withColumn("category", erp_category(F.col(name)))


def categorize_products_mdm(products: DataFrame, name: str = "product_name") -> DataFrame:
    return products.withColumn("category", mdm_category(F.col(name)))


def normalize_code(code: Column) -> Column:
    """Upper-case, trimmed, without trailing letters: 85123a and 85123B become 85123."""
    return F.regexp_replace(F.upper(strip(code)), "[A-Za-z]+$", "")


def sentiment_label(flag: Column) -> Column:
    return F.when(F.coalesce(flag, F.lit(1)) == 1, "positive").otherwise("negative")


def derived_rating(sentiment: Column, key: Column) -> Column:
    """3.5 to 5.0 for positive reviews and 1.0 to 2.5 for others, fixed by the key."""
    tenths = F.when(sentiment == "positive", 35).otherwise(10) + F.pmod(key, F.lit(16))
    return (tenths.cast("decimal(3,0)") / F.lit(10)).cast("decimal(3,1)")


def derived_review_ts(key: Column) -> Column:
    """A date in the 18 months from 2024, fixed by the key."""
    days = F.pmod(key * 37, F.lit(REVIEW_DAYS)).cast("int")
    return F.date_add(F.lit(REVIEW_EPOCH).cast("date"), days).cast("timestamp_ntz")


def clean_reviews(raw: DataFrame) -> DataFrame:
    """Reviews with sentiment, rating, date, whole text and a 500-character excerpt.

    ``raw`` has ``review_key``, ``review_text`` and the flag ``sentiment_flag``.
    """
    labelled = raw.withColumn("sentiment", sentiment_label(F.col("sentiment_flag")))
    return labelled.select(
        "review_key",
        "review_text",
        F.substring("review_text", 1, EXCERPT_CHARS).alias("review_excerpt"),
        "sentiment",
        derived_rating(F.col("sentiment"), F.col("review_key")).alias("rating"),
        derived_review_ts(F.col("review_key")).alias("review_ts"),
    )
