from __future__ import annotations

from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from tillframe.functions.ordering import exact_quantiles, quantile_row, with_position
from tillframe.functions.skew import hot_keys, join_keyed, join_totals
from tillframe.functions.text import match_keywords
from tillframe.sources import storage
from tillframe.sources.storage import materialize, shared_dir, spread


def test_positions_are_global_and_dense(spark):
    df = spark.range(5000).select(((F.col("id") * 7919) % 5000).alias("k")).repartition(7)
    got = with_position(df, [F.desc("k")], "p").collect()
    assert sorted((r.p, r.k) for r in got) == [(i, 4999 - i) for i in range(5000)]


def test_positions_with_a_tied_leading_key(spark):
    df = spark.range(3000).select(F.lit(1).alias("hot"), "id")
    got = with_position(df, ["hot", "id"], "p").collect()
    assert all(r.p == r.id for r in got)


def test_positions_of_an_empty_table(spark):
    assert with_position(spark.range(0), ["id"], "p").count() == 0


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_quantiles_match_numpy(spark, seed):
    rng = np.random.default_rng(seed)
    a = np.where(rng.random(999) < 0.4, 0.0, rng.normal(size=999).round(2))  # one value holds a third
    b = rng.integers(0, 50, 999).astype(float)
    df = spark.createDataFrame([(float(x), float(y)) for x, y in zip(a, b)], "a double, b double")
    table = {r.column: r for r in exact_quantiles(df, ["a", "b"], {"m": 0.5, "q": 0.7, "lo": 0.0, "hi": 1.0}).collect()}
    for name, values in (("a", a), ("b", b)):
        for field, p in (("m", 0.5), ("q", 0.7), ("lo", 0.0), ("hi", 1.0)):
            assert table[name][field] == pytest.approx(np.quantile(values, p))


def test_quantiles_ignore_nulls_and_missing_columns(spark):
    df = spark.createDataFrame([(1.0, None), (3.0, None), (None, None)], "a double, b double")
    row = quantile_row(df, {"ma": ("a", 0.5), "mb": ("b", 0.5)}).first()
    assert row.ma == 2.0 and row.mb is None


def skewed(spark):
    facts = spark.range(6000).select(
        F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 2000 + 100).cast("long").alias("k"), "id"
    )
    facts = facts.unionByName(spark.createDataFrame([(None, 1), (99999, 2)], "k long, id long"))
    keyed = spark.range(3000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    return facts, keyed


def test_hot_keys_are_found(spark):
    facts, _ = skewed(spark)
    assert [r.k for r in hot_keys(facts, "k", 0.1).collect()] == [7]


@pytest.mark.parametrize("how", ["left", "inner"])
def test_salted_join_equals_plain_join(spark, rows, how):
    facts, keyed = skewed(spark)
    want = rows(facts.join(keyed, "k", how), "k", "id", "v")
    assert rows(join_keyed(facts, keyed, "k", how, broadcast_rows=0), "k", "id", "v") == want
    assert rows(join_keyed(facts, keyed, "k", how), "k", "id", "v") == want


def test_salted_join_spreads_the_hot_key(spark):
    facts, keyed = skewed(spark)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        joined = join_keyed(facts, keyed, "k", "left", broadcast_rows=0)
        sizes = joined.groupBy(F.spark_partition_id().alias("p")).count().collect()
        assert max(r["count"] for r in sizes) < 6000 * 0.5
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")


class Session:
    """Just enough of a session to look up a folder."""

    def __init__(self, master, configured=None, context_dir=None):
        self.conf = {"spark.checkpoint.dir": configured} if configured else {}
        self.sparkContext = SimpleNamespace(master=master, applicationId=f"app-{master}", getCheckpointDir=lambda: context_dir)


def test_shared_dir_follows_the_session():
    assert shared_dir(Session("yarn", "hdfs:///work/")) == "hdfs:///work"
    assert shared_dir(Session("yarn", None, "hdfs:///ctx")) == "hdfs:///ctx"
    local = Session("local[2]")
    assert shared_dir(local) == shared_dir(local)
    with pytest.raises(RuntimeError):  # never a folder of one machine on a cluster
        shared_dir(Session("yarn"))


def test_spread_leaves_large_inputs_alone(spark, monkeypatch):
    scan = spark.range(100, numPartitions=1)
    assert spread(scan).rdd.getNumPartitions() > 1
    monkeypatch.setattr(storage, "SPREAD_BYTES", 10)
    assert spread(scan).rdd.getNumPartitions() == 1


def test_hot_keys_are_counted_in_a_scan(spark):
    """The joins behind the facts run once, not once more for the count of hot keys."""
    line = spark.createDataFrame([(i, 1 if i < 90 else i) for i in range(100)] + [(100, None)], "o long, k long")
    order = spark.range(100).withColumnRenamed("id", "o").withColumn("x", F.col("o") * 2)
    keyed = spark.range(95).select(F.col("id").alias("k"), F.col("id").alias("y"))
    facts = line.join(order, "o")
    joined = join_keyed(facts, keyed, "k", "inner", keyed_rows=95, broadcast_rows=0, keys_of=line)
    plain = facts.join(keyed, "k").select(*joined.columns)
    assert sorted(joined.collect()) == sorted(plain.collect())
    assert joined._jdf.queryExecution().optimizedPlan().toString().count("Range (0, 100") == 1


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_totals_are_summed_where_they_are_joined(spark):
    """As the join of the sums, with rows that move once; a hot key, keys without a partner and null keys."""
    rows = spark.range(4000).select(
        F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 50 > 1, (F.col("id") % 700).cast("string")).alias("key"),
        (F.col("id") % 17).alias("who"), (F.col("id") % 11).alias("v"),
    )
    keyed = spark.range(600).select(F.col("id").cast("string").alias("key"), (F.col("id") * 2).alias("x"))
    keyed = keyed.unionByName(spark.createDataFrame([("hot", 5)], "key string, x long"))
    totals = [F.sum("v").alias("v"), F.count("*").alias("n")]
    sums = rows.groupBy("who", "key").agg(*totals)
    old = join_keyed(sums, keyed, "key", "left", broadcast_rows=0)
    for limit in (0, 10_000):
        new = join_totals(rows, ["who", "key"], totals, keyed, "key", broadcast_rows=limit)
        columns = ["who", "key", "v", "n", "x"]
        assert sorted(map(repr, new.select(columns).collect())) == sorted(map(repr, old.select(columns).collect()))
        if not limit:
            assert plan_of(new).count("Exchange hashpartitioning(") < plan_of(old).count("Exchange hashpartitioning(")


def test_files_sorted_in_place(spark):
    """``sort_by`` moves no row: every file is sorted, and holds what its partition held."""
    df = spark.range(0, 4000, 1, 4).select((F.col("id") * 7919 % 4000).alias("k"), F.spark_partition_id().alias("part"))
    stored = materialize(df, "in-place", sort_by=["k"])
    files = stored.select("k", "part", F.input_file_name().alias("f")).collect()
    held = {}
    for r in files:
        held.setdefault(r.f, []).append(r)
    assert len(held) == 4 and all(len({r.part for r in rows}) == 1 for rows in held.values())
    assert all([r.k for r in rows] == sorted(r.k for r in rows) for rows in held.values())


def test_texts_are_moved_only_for_keywords_with_blanks(spark):
    texts = spark.createDataFrame([(1, "A hot bolt"), (2, "old ring"), (3, None)], "id long, text string")

    def found(*keywords):
        return match_keywords(texts, spark.createDataFrame([(k,) for k in keywords], "keyword string"))

    one, two, none = found("ring", "OL"), found("ring", "hot b"), found()
    assert sorted(map(tuple, one.collect())) == [(1, "ol"), (2, "ol"), (2, "ring")]
    assert sorted(map(tuple, two.collect())) == [(1, "hot b"), (2, "ring")]
    assert none.collect() == [] and none.dtypes == one.dtypes
    assert "Contains" not in plan_of(one) and "Contains" in plan_of(two) and "Scan" not in plan_of(none).replace("LocalTableScan", "")


def test_sizes_of_the_scans_below_a_frame(spark, tmp_path):
    spark.range(1000).write.parquet(str(tmp_path / "t"))
    one = spark.read.parquet(str(tmp_path / "t"))
    other = spark.read.parquet(str(tmp_path / "t")).select((F.col("id") + 1).alias("id"))
    assert 0 < storage.scan_bytes(one) * 2 == storage.scan_bytes(one.join(other, "id").where("id > 5"))
