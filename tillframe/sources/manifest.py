"""Which source files changed since the last load."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillframe.sources.storage import materialize

MANIFEST = "path string, sha256 string, run_ts timestamp"


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def fingerprints(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """(path, sha256) of the files that exist, by their content whatever their size.

    Files are read as lines, split over tasks: the fingerprint is a hash of the
    number of lines and of sums over the hashes of the lines. The order of lines
    does not count, as it does not count in a load. An empty file has no lines
    and is in the result too.
    """
    present = [p for p in paths if path_exists(spark, p)]
    if not present:
        return spark.createDataFrame([], "path string, sha256 string")
    digest = F.sha2(F.col("value").cast("binary"), 256)
    half = [F.conv(F.substring(digest, 1 + 15 * i, 15), 16, 10).cast("decimal(20,0)") for i in range(3)]
    lines = spark.read.text(present).select(F.col("_metadata.file_path").alias("key"), *[h.alias(f"h{i}") for i, h in enumerate(half)])
    sums = lines.groupBy("key").agg(F.count("*").alias("n"), *[F.sum(f"h{i}").alias(f"s{i}") for i in range(3)])
    name = F.col("_metadata.file_path").alias("key")
    files = spark.read.format("binaryFile").load(present).select("path", name)  # no content is read
    content = F.concat_ws("|", F.coalesce("n", F.lit(0)), *[F.coalesce(f"s{i}", F.lit(0)) for i in range(3)])
    filled = files.join(sums, "key", "left").select("path", F.sha2(content, 256).alias("sha256"))
    empty = spark.createDataFrame([(p,) for p in _empty_files(spark, present)], "path string")
    return filled.unionByName(empty.select("path", F.sha2(F.lit("0"), 256).alias("sha256")))


def _empty_files(spark: SparkSession, paths: Sequence[str]) -> list[str]:
    """Those of ``paths`` that are files without content, which no reader lists."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    found = []
    for p in paths:
        target = jvm.org.apache.hadoop.fs.Path(p)
        status = target.getFileSystem(conf).getFileStatus(target)
        if status.isFile() and status.getLen() == 0:
            found.append(status.getPath().toString())
    return found


def read_manifest(spark: SparkSession, manifest: str) -> DataFrame:
    if not path_exists(spark, manifest):
        return spark.createDataFrame([], MANIFEST)
    return spark.read.schema(MANIFEST).parquet(manifest)


def changed_sources(current: DataFrame, manifest: str, force: bool = False) -> DataFrame:
    """(path, sha256) of new or changed files among ``current`` fingerprints; of all files with ``force``."""
    if force:
        return current
    return current.join(read_manifest(current.sparkSession, manifest), ["path", "sha256"], "left_anti")


def should_run(spark: SparkSession, paths: Sequence[str], manifest: str, force: bool = False) -> tuple[bool, DataFrame]:
    """Whether to load, and the stored fingerprints this was decided on.

    The same fingerprints go to ``record_sources`` after the load: a file that is
    replaced meanwhile differs from its record and is loaded next time.
    """
    current = materialize(fingerprints(spark, paths), "fingerprints")
    changed = changed_sources(current, manifest, force).limit(1).count()
    return force or bool(changed), current


def record_sources(current: DataFrame, manifest: str) -> None:
    """Replace the manifest by the fingerprints that ``should_run`` took before the load."""
    current.withColumn("run_ts", F.current_timestamp()).write.mode("overwrite").parquet(manifest)
