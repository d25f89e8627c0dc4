from __future__ import annotations

from datetime import datetime
from decimal import Decimal as D

import duckdb
import pytest
from pyspark.sql import functions as F

from tillframe.operators import marts, quality, reports

MAPPING = "mapping_id long, product_id string, product_name string, review_code string, category string, golden_name string, match_score double, match_strategy string"
SALES = "invoice_no string, product_id string, quantity long, revenue decimal(12,2), margin decimal(12,2), invoice_ts timestamp_ntz, customer_id string"
REVIEWS = "review_id long, review_key long, review_code string, rating decimal(3,1), sentiment string, review_ts timestamp_ntz"


def mapped(i, pid, code, cat="Divers", how="rank"):
    return (i, pid, f"NAME {pid}", code, cat, f"NAME {pid}", 0.0, how)


def sold(no, pid, qty, revenue, who, day=1, month=1):
    return (no, pid, qty, D(revenue), D("0.10"), datetime(2023, month, day), who)


def review(i, code, rating, sentiment="positive", day=1):
    return (i, i, code, D(rating) if rating else None, sentiment, datetime(2024, 1, day))


@pytest.fixture
def shop(spark):
    mapping = spark.createDataFrame(
        [
            mapped(1, "A", "R1", "Sacs & Accessoires"),
            mapped(2, "B", "R1"),  # shares its code with A
            mapped(3, "C", "R2"),
            mapped(4, "D", "R3"),  # sold, not reviewed
            mapped(5, "E", "R4"),  # neither sold nor reviewed
        ],
        MAPPING,
    )
    sales = spark.createDataFrame(
        [
            sold("I1", "A", 60, "10.05", "c1"),
            sold("I1", "A", 1, "20.10", "c1"),
            sold("I2", "B", 5, "7.77", "c1", 2),
            sold("I3", "D", 50, "100.00", "c2", 31, 3),
            sold("I4", "A", 2, "1.01", "c2", 1, 3),
            sold("I5", "unmapped", 9, "3.33", "c3"),
        ],
        SALES,
    )
    reviews = spark.createDataFrame(
        [
            review(1, "R1", "2.0", "negative"),
            review(2, "R1", "4.5", day=3),
            review(3, "R1", None, "neutral", 2),
            review(4, "R2", "3.5"),  # reviewed, not sold
            review(5, None, "1.0", "negative"),
        ],
        REVIEWS,
    )
    customers = spark.createDataFrame(
        [("c1", "Client_c1", "UK"), ("c2", "Client_c2", "FR"), ("c3", "Client_c3", None), ("idle", "Client_idle", "FR")],
        "customer_id string, name string, country string",
    )
    return mapping, sales, reviews, customers


def duck(**frames):
    con = duckdb.connect()
    for name, df in frames.items():
        con.register(name, df.toPandas())
    return con


@pytest.mark.parametrize("rows_known", [None, 10**9])
def test_customer_kpi_equals_the_repeating_join(shop, rows, rows_known):
    mapping, sales, reviews, customers = shop
    con = duck(mapping=mapping, sales=sales, reviews=reviews, customers=customers)
    want = con.execute(
        """SELECT c.customer_id, count(DISTINCT s.invoice_no), count(DISTINCT s.product_id),
           round(sum(s.revenue), 2)::DOUBLE, round(avg(s.revenue)::DECIMAL(20,9), 2)::DOUBLE,
           round(avg(r.rating)::DECIMAL(20,9), 2)::DOUBLE, count(r.review_id)
           FROM customers c LEFT JOIN sales s USING (customer_id) LEFT JOIN mapping m ON m.product_id = s.product_id
           LEFT JOIN reviews r ON r.review_code = m.review_code GROUP BY 1"""
    ).fetchall()
    got = marts.customer_kpi(customers, sales, mapping, reviews, rows_known)
    picked = rows(got, "customer_id", "orders", "products", "revenue", "avg_basket", "avg_rating", "reviews")
    assert picked == sorted(want, key=repr)
    idle = next(r for r in got.collect() if r.customer_id == "idle")
    assert idle.revenue is None and idle.orders == 0 and idle.reviews == 0


def test_product_kpi_equals_the_repeating_join(shop, rows):
    mapping, sales, reviews, _ = shop
    con = duck(mapping=mapping, sales=sales, reviews=reviews)
    want = con.execute(
        """SELECT m.product_id, coalesce(sum(s.revenue), 0)::DOUBLE, coalesce(sum(s.margin), 0)::DOUBLE,
           coalesce(sum(s.quantity), 0)::BIGINT, round(avg(r.rating)::DECIMAL(20,9), 2)::DOUBLE, count(r.review_id),
           count(*) FILTER (r.sentiment = 'positive'), count(*) FILTER (r.sentiment = 'negative'),
           count(*) FILTER (r.sentiment = 'neutral')
           FROM mapping m LEFT JOIN sales s ON s.product_id = m.product_id
           LEFT JOIN reviews r ON r.review_code = m.review_code GROUP BY 1"""
    ).fetchall()
    got = marts.product_kpi(mapping, sales, reviews)
    columns = ("product_id", "revenue", "margin", "quantity", "avg_rating", "reviews", "positive", "negative", "neutral")
    assert rows(got, *columns) == sorted(want, key=repr)


def test_exact_marts_do_not_repeat(shop):
    mapping, sales, reviews, customers = shop
    product = {r.product_id: r for r in marts.product_kpi_exact(mapping, sales, reviews).collect()}
    assert product["A"].revenue == 31.16 and product["A"].quantity == 63 and product["A"].reviews == 3
    assert product["C"].revenue == 0.0 and product["C"].avg_rating == 3.5 and product["E"].avg_rating is None
    customer = {r.customer_id: r for r in marts.customer_kpi_exact(customers, sales, mapping, reviews).collect()}
    assert customer["c1"].revenue == 37.92 and customer["c1"].avg_basket == 12.64 and customer["c3"].reviews == 0


def test_status_limits(spark):
    data = [(2.99, 51), (2.99, 50), (3.0, 51), (3.49, 99), (3.5, 99), (None, 99)]
    df = spark.createDataFrame(data, "r double, q long")
    got = [x.s for x in df.select(marts.alert_status(F.col("r"), F.col("q")).alias("s")).collect()]
    assert got == ["CRITIQUE", "A_SURVEILLER", "A_SURVEILLER", "A_SURVEILLER", "OK", "OK"]


def test_alerts_and_listing(shop):
    mapping, sales, reviews, _ = shop
    kpi = marts.product_kpi(mapping, sales, reviews)
    alerts = marts.product_alerts(kpi)
    assert [(r.product_id, r.status) for r in alerts.collect()] == [("A", "A_SURVEILLER"), ("B", "A_SURVEILLER"), ("C", "OK")]
    everything = {r.product_id: r.status for r in reports.product_listing(kpi, alerts).collect()}
    assert everything["D"] == "OK" and everything["E"] == "OK"
    fine = [r.product_id for r in reports.product_listing(kpi, alerts, status="OK").collect()]
    assert fine == ["C"]  # unreviewed products show as fine but do not pass the filter
    assert reports.best_rated_products(kpi, 1).first().avg_rating is None


def test_quality_summary_and_profile(shop):
    mapping, sales, reviews, customers = shop
    products = mapping.select("product_id", "product_name", "category")
    row = marts.data_quality_summary(products, customers, mapping, sales, reviews).first()
    assert (row.reviewed_codes, row.linked_reviews, row.reviews, row.invoices, row.coverage_pct) == (2, 4, 5, 5, 40.0)
    profile = {r.table_name: (r.rows, r.columns) for r in marts.table_profile({"s": sales, "m": mapping}).collect()}
    assert profile == {"s": (6, 7), "m": (5, 8)}


def test_orphans(shop):
    mapping, sales, _, customers = shop
    report = marts.fk_orphans([("p", sales, "product_id", mapping, "product_id"), ("c", sales, "customer_id", customers, "customer_id")])
    assert sorted(tuple(r) for r in report.collect()) == [("c", 0, 0), ("p", 1, 1)]
    repaired = marts.clear_orphans(sales, "product_id", mapping, "product_id")
    assert repaired.count() == 6 and repaired.where("product_id IS NULL").count() == 1


def test_periods(shop):
    _, sales, _, customers = shop
    months = reports.revenue_by_period(sales, "month", "2023-01-01", "2023-03-31").collect()
    assert [(r.period.month, r.revenue, r.invoices) for r in months] == [(1, 41.25, 3), (3, 101.01, 2)]
    # the end is midnight: a later sale on the last day is out
    late = sales.withColumn("invoice_ts", F.expr("invoice_ts + interval 10 hours"))
    assert reports.revenue_by_period(late, "year", "2023-01-01", "2023-03-31").first().revenue == 42.26
    with pytest.raises(ValueError):
        reports.in_range(sales, "2023-02-01", "2023-01-01")
    with pytest.raises(ValueError):
        reports.revenue_by_period(sales, "week", "2023-01-01", "2023-02-01")
    total = reports.geo_totals(reports.sales_by_country(sales, customers)).first()
    assert (total.countries, total.customers) == (2, 3)


def test_comparison_transposed(shop):
    mapping, sales, reviews, _ = shop
    kpi = marts.product_kpi(mapping, sales, reviews)
    table = {r.metric: r for r in reports.comparison_transposed(reports.product_comparison(kpi, ["A", "D"])).collect()}
    assert table["category"].product_1 == "Sacs & Accessoires" and table["revenue"].product_2 == "100.00"
    assert table["avg_rating"].product_2 is None and table["revenue"].product_3 is None


def test_review_fallbacks(spark, shop):
    _, _, reviews, _ = shop
    products = spark.createDataFrame(
        [("A", "NAME A"), ("P", "BIG LAMP'S LAMP"), ("Q", "BLUE BIRD"), ("Z", "TOE")], "product_id string, product_name string"
    )
    mapping = spark.createDataFrame([mapped(1, "A", "R1"), mapped(2, "P", "none"), mapped(3, "Q", "none2"), mapped(4, "Z", "none3")], MAPPING)
    texts = spark.createDataFrame(
        [(1, "a Lamps shop"), (2, "the LAMP and lamps"), (3, None), (4, "no hit"), (5, "bluelamp")], "id long, text string"
    )
    got = {(r.product_id, r.rating, r.source): r.reviews for r in reports.rating_distribution(products, mapping, reviews, texts).collect()}
    assert got == {
        ("A", 2.0, "mapping"): 1, ("A", 4.5, "mapping"): 1, ("A", None, "mapping"): 1,
        ("P", 2.0, "keywords"): 1, ("P", 4.5, "keywords"): 1, ("P", 1.0, "keywords"): 1,
        ("Q", 1.0, "keywords"): 1,
    }
    latest = {}
    for r in sorted(reports.latest_reviews(products, mapping, reviews, texts).collect(), key=lambda r: (r.product_id, r.place)):
        latest.setdefault((r.product_id, r.source), []).append(r.review_id)
    assert latest == {("A", "mapping"): [2, 3, 1], ("P", "keywords"): [2, 1, 5], ("Q", "keywords"): [5], ("Z", "overall"): [2, 3, 1]}


def test_alert_text(spark):
    row = ("P", "LAMP", "Luminaires", 2.5, 10, 7, 1234567.5)
    df = spark.createDataFrame([row], "product_id string, product_name string, category string, avg_rating double, reviews long, negative long, revenue double")
    text = reports.alert_messages(df).first().message
    assert text == "LAMP [Luminaires] Note : 2.50/5 | 7 avis négatifs / 10 total | CA : 1,234,568 EUR"


# --- data quality -------------------------------------------------------------------


def check(spark, rule, values, kind):
    df = spark.createDataFrame([(v,) for v in values], f"x {kind}")
    return quality.run_suite(df, "s", [rule]).first()


@pytest.mark.parametrize(
    ("rule", "kind", "good", "bad", "failed"),
    [
        (quality.no_nulls("x"), "int", [1, 2, 3], [1, None, 3], 1),
        (quality.no_nulls("x"), "int", [], [None], 1),
        (quality.min_rows(3), "int", [1, 2, 3], [1], 2),
        (quality.unique("x"), "int", [1, 2, None], [1, 2, 2, None, None], 2),
        (quality.values_in_set("x", ("A", "B")), "string", ["A", "B"], ["A", "Z", None], 2),
        (quality.column_between("x", 0, 10), "int", [0, 5, 10, None], [-1, 2, 15], 2),
        (quality.positive_values("x"), "int", [1, 5, None], [0, 5, -1], 2),
    ],
)
def test_rules(spark, rule, kind, good, bad, failed):
    assert check(spark, rule, good, kind).passed
    result = check(spark, rule, bad, kind)
    assert not result.passed and result.failed_rows == failed


def test_future_dates(spark):
    rule = quality.no_future_dates("x")
    assert rule.severity == "warning"
    assert check(spark, rule, [datetime(2020, 1, 1), None], "timestamp_ntz").passed
    assert not check(spark, rule, [datetime(2099, 1, 1)], "timestamp_ntz").passed
    assert not check(spark, quality.no_future_dates("x", "2020-01-01 00:00:00"), [datetime(2021, 6, 15)], "timestamp_ntz").passed


def test_set_rule_shows_at_most_five_samples(spark):
    detail = check(spark, quality.values_in_set("x", ("A",)), list("AZYXWVUU"), "string").detail
    assert detail == "7 value(s) outside the set: [U, V, W, X, Y]"


def test_report_and_gate(spark):
    df = spark.createDataFrame([(-1,)], "x int")
    warned = quality.run_suite(df, "warned", [quality.positive_values("x", "warning")])
    failed = quality.run_suite(df, "failed", [quality.positive_values("x"), quality.no_nulls("x")])
    report = quality.dq_report([warned, failed])
    got = {r.suite: (r.passed, r.rules, r.errors, r.warnings) for r in report.collect()}
    assert got == {"warned": (True, 1, 0, 1), "failed": (False, 2, 1, 0)}
    assert quality.quality_gate(quality.dq_report([warned]))
    assert not quality.quality_gate(report, force=True)
    with pytest.raises(quality.QualityError):
        quality.quality_gate(report)


def test_reviews_per_name(spark, rows):
    texts = spark.createDataFrame([(1, "a red mug"), (2, "MUGS"), (3, "reds and blues"), (4, None)], "id long, text string")
    names = spark.createDataFrame([("REDS MUGS",), ("MUGS",), ("BIRD CAGE",), ("MUGS",), (None,)], "product_name string")
    got = rows(reports.review_keyword_search(texts, names))
    assert got == [("MUGS", 1), ("REDS MUGS", 2)]


def test_too_many_products_to_compare(spark):
    kpi = spark.createDataFrame([(f"P{i}", "N", "C", 1.0, 1.0, 1, 1.0, 1, 1, 0) for i in range(5)], "product_id string, product_name string, category string, revenue double, margin double, quantity int, avg_rating double, reviews int, positive int, negative int")
    with pytest.raises(ValueError, match="more than 4"):
        reports.comparison_transposed(reports.product_comparison(kpi, [f"P{i}" for i in range(5)]))


def test_a_hot_product_gives_the_same_customer_marts(spark, rows):
    """A third of the lines and reviews on one product, with and without spreading."""
    mapping = spark.createDataFrame([mapped(i, f"P{i}", f"R{i % 7}") for i in range(1, 40)], MAPPING)
    sales = spark.createDataFrame(
        [sold(f"I{i % 211}", "P1" if i % 3 == 0 else f"P{i % 45}", i % 9 + 1, f"{i % 50 + 1}.25", f"c{i % 23}") for i in range(1500)], SALES
    )
    reviews = spark.createDataFrame([review(i, "R1" if i % 3 == 0 else f"R{i % 9}", f"{i % 4 + 1}.5") for i in range(1, 90)], REVIEWS)
    customers = sales.select("customer_id", F.col("customer_id").alias("name"), F.lit("UK").alias("country")).distinct()
    small = marts.customer_kpi(customers, sales, mapping, reviews, 10)
    large = marts.customer_kpi(customers, sales, mapping, reviews, 10**9)
    assert rows(small) == rows(large) and small.count() == 23
    a = reports.customer_satisfaction(small, sales, mapping, reviews, None, 10)
    b = reports.customer_satisfaction(small, sales, mapping, reviews, None, 10**9)
    assert rows(a) == rows(b)
