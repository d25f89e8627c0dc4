"""Marts from streamed facts against full recomputation; mapping history over loads."""

from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tests.test_load import sales_csv
from tillframe.operators import marts, matching
from tillframe.operators.cleaning import clean_sales, rename_sales
from tillframe.plans.load import HISTORY, current_version, mapping_history, publish
from tillframe.sources.files import SALES_SCHEMA
from tillframe.streaming import mart_updates as mu


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture
def dimensions(spark):
    mapping = spark.createDataFrame(
        [(k + 1, code, f"NAME {k}", "c", f"REV_{k % 3}") for k, code in enumerate(["85123A", "85123B", "71053", "84406B", "none"])],
        "mapping_id long, product_id string, golden_name string, category string, review_code string",
    )
    return mapping


def reviews(spark, start, count):
    made = [(start + k, f"REV_{k % 4}" if k % 7 else None, f"{1 + (start + k) % 5}.0" if k % 3 else None, ["positive", "negative", "neutral"][k % 3]) for k in range(count)]
    return spark.createDataFrame(made, "review_id long, review_code string, rating string, sentiment string").withColumn("rating", F.col("rating").cast("decimal(3,1)"))


def test_streams_equal_full_recomputation(spark, tmp_path, dimensions):
    source, texts = tmp_path / "sales", tmp_path / "reviews"
    source.mkdir()
    sales_at, reviews_at = str(tmp_path / "facts-s"), str(tmp_path / "facts-r")
    for n in range(3):
        (source / f"{n}.csv").write_text(sales_csv(60 + 20 * n, start=100 * n))
        reviews(spark, 50 * n, 30 + n).coalesce(1).write.mode("append").json(str(texts))
        assert mu.stream_sales(spark, str(source), sales_at, str(tmp_path / "c1")) == 1
        assert mu.stream_reviews(spark, str(texts), reviews_at, str(tmp_path / "c2")) == 1
        lines = clean_sales(rename_sales(spark.read.schema(SALES_SCHEMA).option("header", True).csv(str(source))))
        linked = spark.read.schema(mu.REVIEW_SCHEMA).json(str(texts))
        codes = [r.product_id for r in lines.select("product_id").distinct().collect()]
        mapping = dimensions.unionByName(spark.createDataFrame([(100 + k, c, c, "c", f"REV_{k % 5}") for k, c in enumerate(sorted(codes))], dimensions.schema))
        mapping = mapping.dropDuplicates(["product_id"])
        customers = lines.groupBy("customer_id").agg(F.first("country").alias("country")).withColumn("name", F.col("customer_id"))
        now = mu.current_marts(spark, sales_at, reviews_at, mapping, customers)
        kpi = marts.product_kpi(mapping, lines, linked)
        assert rows_of(now["product_kpi"]) == rows_of(kpi) and kpi.where("reviews > 0 AND revenue > 0").count() > 0
        assert rows_of(now["product_alerts"]) == rows_of(marts.product_alerts(kpi))
        assert rows_of(now["customer_kpi"]) == rows_of(marts.customer_kpi(customers, lines, mapping, linked))
    assert mu.stream_sales(spark, str(source), sales_at, str(tmp_path / "c1")) == 0


def test_a_batch_counts_once_and_can_be_taken_back(spark, tmp_path):
    target = str(tmp_path / "facts")
    lines = spark.createDataFrame([("c1", "p1", "i1", 10.0, 2.0, 3), ("c1", "p1", "i1", 5.0, 1.0, 1), ("c2", "p1", "i2", 1.0, 0.5, 1)], "customer_id string, product_id string, invoice_no string, revenue double, margin double, quantity long")
    assert mu.last_batch(spark, target) == -1
    assert mu.merge_batch(target, 0, mu.sales_deltas(lines))
    once = rows_of(mu.facts(spark, target, "lines")), rows_of(mu.facts(spark, target, "invoices"))
    assert not mu.merge_batch(target, 0, mu.sales_deltas(lines))  # run again after a failure
    assert (rows_of(mu.facts(spark, target, "lines")), rows_of(mu.facts(spark, target, "invoices"))) == once
    assert once[1] == [("c1", "i1", 2), ("c2", "i2", 1)]
    assert mu.merge_batch(target, 1, mu.sales_deltas(lines.where("customer_id = 'c2'"), F.lit(-1)))
    assert [r[:2] for r in rows_of(mu.facts(spark, target, "lines"))] == [("c1", "p1")] and mu.last_batch(spark, target) == 1
    broken = {"lines": spark.range(1).select(F.raise_error(F.lit("broken")).cast("string").alias("customer_id"), *[F.lit(None).cast(t).alias(c) for c, t in {"product_id": "string", **mu.LINE_SUMS}.items()])}
    with pytest.raises(Exception, match="broken"):
        mu.merge_batch(target, 2, broken)
    assert mu.last_batch(spark, target) == 1 and rows_of(mu.facts(spark, target, "invoices")) == [("c1", "i1", 2)]


MAPPING = "product_id string, review_code string, golden_name string, match_score double, match_strategy string"


def test_history_is_kept_over_loads(spark, tmp_path):
    target = str(tmp_path / "out")
    first = spark.createDataFrame([("a", "R1", "A", 0.0, "rank"), ("b", "R2", "B", 1.0, "hard"), ("c", "R3", "C", 0.9, "fuzzy")], MAPPING)
    second = spark.createDataFrame([("a", "R1", "A", 0.0, "rank"), ("b", "R9", "B", 1.0, "hard"), ("d", "R4", "D", 0.0, "rank")], MAPPING)
    days = [datetime(2024, 1, 1), datetime(2024, 2, 1), datetime(2024, 3, 1)]
    for mapping, day in ((first, days[0]), (second, days[1]), (second, days[2])):
        publish({"mapping": mapping, HISTORY: mapping_history(spark, target, mapping, day)}, target)
    history = spark.read.parquet(f"{current_version(spark, target)}/{HISTORY}")
    got = sorted((r.product_id, r.review_code, r.valid_from, r.valid_to) for r in history.where("valid_to IS NULL").collect())
    assert got == [("a", "R1", days[0], None), ("b", "R9", days[1], None), ("d", "R4", days[1], None)]
    closed = sorted((r.product_id, r.review_code, r.valid_from, r.valid_to) for r in history.where("valid_to IS NOT NULL").collect())
    assert closed == [("b", "R2", days[0], days[1]), ("c", "R3", days[0], days[1])]
    sales = spark.createDataFrame([(p, t) for p in "abcd" for t in (datetime(2023, 12, 1), days[0], datetime(2024, 1, 31), days[1], datetime(2025, 1, 1))], "product_id string, at timestamp_ntz")
    seen = {(r.product_id, r.at): r.review_code for r in matching.mapping_as_of(sales, history, "at").collect()}
    assert len(seen) == 20 and seen["b", datetime(2024, 1, 31)] == "R2" and seen["b", days[1]] == "R9"
    assert seen["c", days[1]] is None and seen["d", days[0]] is None and seen["a", datetime(2025, 1, 1)] == "R1" and seen["a", datetime(2023, 12, 1)] is None
