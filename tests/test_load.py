from __future__ import annotations

import json
from functools import partial

import pytest
from pyspark.sql import functions as F

from tillframe.operators.quality import QualityError
from tillframe.plans.load import TABLES, attach_reviews, create_views, current_version, empty_tables, publish, run_load
from tillframe.sources import files, manifest
from tillframe.streaming.incremental import ingest_new_sales

HEADER = "Invoice,StockCode,Description,Quantity,InvoiceDate,Price,Customer ID,Country\n"
NAMES = ["RED MUG", "BLUE BAG", "WHITE HEART LAMP", "RED MUGS", "GIFT BOX"]


def published(spark, target, table):
    return spark.read.parquet(f"{current_version(spark, target)}/{table}")


def sales_csv(count, start=0):
    lines = [
        f"{'C' if i % 10 == 9 else ''}{i},{85000 + i % 5}A,{NAMES[i % 5]},{i % 7 + 1},2010-{i % 12 + 1:02d}-03 08:26:00,{i % 9 + 0.55},{12000 + i % 40},France\n"
        for i in range(start, start + count)
    ]
    return HEADER + "".join(lines)


@pytest.fixture
def sources(tmp_path):
    sales, reviews = tmp_path / "sales.csv", tmp_path / "reviews.json"
    sales.write_text(sales_csv(1500), encoding="utf-8")
    data = [{"review": f"avis {i}", "sentimen": i % 2, "translate": f"the red mug number {i} is fine"} for i in range(150)]
    data += [{"review": "only original", "sentiment": 0}, {"translate": "no label"}, {"sentimen": 1}]
    reviews.write_text(json.dumps(data), encoding="utf-8")
    return sales, reviews


def test_fingerprints(spark, tmp_path):
    a, b, c = tmp_path / "a.csv", tmp_path / "b é%20.csv", tmp_path / "empty.csv"
    a.write_text("a,b,c\n1,2,3\n4,5,6\n")
    b.write_text("a,b,c\n1,2,3\n4,5,6\n")
    c.write_text("")
    paths = [str(a), str(b), str(c), str(tmp_path / "missing.csv")]
    got = {r.path.rsplit("/", 1)[1]: r.sha256 for r in manifest.fingerprints(spark, paths).collect()}
    assert len(got) == 3 and got["a.csv"] == got["b é%20.csv"] != got["empty.csv"]
    a.write_text("a,b,c\n1,2,3\n4,5,6\n4,5,6\n")
    assert manifest.fingerprints(spark, [str(a)]).first().sha256 != got["a.csv"]


def test_change_detection(spark, tmp_path):
    a, b, where = tmp_path / "a.csv", tmp_path / "b.csv", str(tmp_path / "manifest")
    a.write_text("1\n")
    b.write_text("2\n")
    paths = [str(a), str(b)]
    run, seen = manifest.should_run(spark, paths, where)
    assert run
    b.write_text("2\n7,8,9\n")  # replaced while the load runs: what was recorded is what was there before
    manifest.record_sources(seen, where)
    run, seen = manifest.should_run(spark, paths, where)
    assert run and [r.path[-5:] for r in manifest.changed_sources(seen, where).collect()] == ["b.csv"]
    manifest.record_sources(seen, where)
    assert not manifest.should_run(spark, paths, where)[0]
    assert manifest.should_run(spark, paths, where, force=True)[0]


def test_readers(spark, sources):
    sales, reviews = sources
    raw = files.load_sales(spark, str(sales), 0)
    assert raw.count() == 1500 and dict(raw.dtypes)["customer_id"] == "string"
    assert files.load_sales(spark, str(sales), 100).count() == 100
    got = {r.review_text: r.sentiment_flag for r in files.load_reviews(spark, str(reviews), json_lines=False).collect()}
    assert len(got) == 153 and got["only original"] == 0 and got["no label"] == 1 and got[""] == 1
    files.json_array_to_lines(spark, str(reviews), f"{reviews}-lines")
    lines = {r.review_text: r.sentiment_flag for r in files.load_reviews(spark, f"{reviews}-lines").collect()}
    assert lines == got
    keys = [r.review_key for r in files.load_reviews(spark, str(reviews), 50, json_lines=False).collect()]
    assert sorted(keys) == list(range(50))


@pytest.mark.parametrize("strategy", ["semantic", "poc"])
def test_load_publishes_once(spark, sources, tmp_path, strategy):
    target = str(tmp_path / "out")
    args = [spark, *map(str, sources), target]
    load = partial(run_load, json_lines=False)
    assert load(*args, strategy=strategy)
    counts = {t: published(spark, target, t).count() for t in TABLES}
    assert counts == {"products": 5, "customers": 36, "mapping": 5, "sales": 1350, "reviews": 153}
    assert not load(*args, strategy=strategy)  # nothing changed
    assert load(*args, strategy=strategy, force=True)
    reviews = published(spark, target, "reviews")
    assert reviews.where("review_code IS NULL").count() == 0
    assert reviews.select("review_id").distinct().count() == 153
    create_views(spark, target)
    assert spark.sql("SELECT count(*) AS n FROM product_kpi").first().n == 5
    assert spark.sql("SELECT coverage_pct FROM data_quality_summary").first().coverage_pct > 0
    assert spark.sql("SELECT count(*) AS n FROM customer_kpi").first().n == 36
    files.export_csv(reviews.select("review_id", "rating"), str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 153
    empty_tables(spark, target)
    assert published(spark, target, "sales").count() == 0


def test_reviews_follow_their_vectors(spark):
    from tillframe.operators.search import hashed_vectors

    mapping = spark.createDataFrame(
        [(1, "R1", "red mug"), (2, "R2", "blue lamp")], "mapping_id long, review_code string, golden_name string"
    )
    reviews = spark.createDataFrame([(0, "blue lamp"), (1, "red mug red"), (2, "blue lamp lamp")], "review_key long, review_text string")
    for encoder in (hashed_vectors, None):
        got = {r.review_key: r.review_code for r in attach_reviews(reviews, mapping, "semantic", encoder).collect()}
        assert got == {0: "R2", 1: "R1", 2: "R2"}
    nothing = reviews.withColumn("review_text", F.lit(""))  # no vector reaches the threshold: words decide
    got = {r.review_code for r in attach_reviews(nothing, mapping, "semantic", hashed_vectors).collect()}
    assert got == {"R1"}


def test_failed_gate_keeps_the_published_tables(spark, sources, tmp_path):
    sales, reviews = sources
    target = str(tmp_path / "out")
    assert run_load(spark, str(sales), str(reviews), target, strategy="poc", json_lines=False)
    sales.write_text(sales_csv(20), encoding="utf-8")  # fewer than the 1,000 lines required
    with pytest.raises(QualityError):
        run_load(spark, str(sales), str(reviews), target, strategy="poc", json_lines=False)
    assert published(spark, target, "sales").count() == 1350
    assert manifest.should_run(spark, [str(sales), str(reviews)], f"{target}/_manifest")[0]


def test_nothing_is_cut(spark, tmp_path):
    """All products take part in the mapping, and reviews keep their whole text."""
    sales, reviews, target = tmp_path / "sales.csv", tmp_path / "reviews.json", str(tmp_path / "out")
    lines = [f"{i},{90000 + i % 120},THING {i % 120} OF {i % 7},2,12/{i % 28 + 1}/2010 8:26,3.50,{12000 + i % 30},France\n" for i in range(1200)]
    sales.write_text(HEADER + "".join(lines), encoding="utf-8")
    long = "thing 7 of 0 " + "word " * 600 + "end"
    reviews.write_text("".join(json.dumps({"translate": f"{long}{i}", "sentimen": 1}) + "\n" for i in range(120)), encoding="utf-8")
    assert run_load(spark, str(sales), str(reviews), target)
    assert published(spark, target, "mapping").count() == published(spark, target, "products").count() == 120
    got = published(spark, target, "reviews").collect()
    assert len(got) == 120 and all(len(r.review_text) > 3000 and len(r.review_excerpt) == 500 for r in got)


def test_a_failed_publish_leaves_the_old_version(spark, tmp_path):
    target = str(tmp_path / "out")
    one = {"t": spark.createDataFrame([(1,)], "x int")}
    publish(one, target)
    broken = {"t": spark.createDataFrame([(2,)], "x int"), "u": spark.range(3).select(F.raise_error(F.lit("broken")).alias("x"))}
    with pytest.raises(Exception, match="broken"):
        publish(broken, target)
    assert published(spark, target, "t").first().x == 1
    publish({"t": spark.createDataFrame([(3,)], "x int")}, target)
    assert published(spark, target, "t").first().x == 3
    assert sum(p.name.startswith("version-") for p in (tmp_path / "out").iterdir()) == 2  # the new one and the broken one


def test_streaming_loads_each_file_once(spark, tmp_path):
    source, target, checkpoint = tmp_path / "in", tmp_path / "sales", tmp_path / "ckpt"
    source.mkdir()
    (source / "one.csv").write_text(sales_csv(100))
    assert ingest_new_sales(spark, str(source), str(target), str(checkpoint)) == 1
    assert spark.read.parquet(str(target)).count() == 90
    assert ingest_new_sales(spark, str(source), str(target), str(checkpoint)) == 0
    (source / "two.csv").write_text(sales_csv(50, start=100))
    assert ingest_new_sales(spark, str(source), str(target), str(checkpoint)) == 1
    assert spark.read.parquet(str(target)).count() == 135
