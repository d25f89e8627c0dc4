"""Intermediate tables on the cluster's shared folder.

Tables are written once and read back, so that later steps neither recompute
their inputs nor depend on executors that may be lost.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_DIR = "spark.checkpoint.dir"

_local_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named by the session, or a temporary one on a local master."""
    sc = spark.sparkContext
    configured = spark.conf.get(CHECKPOINT_DIR, None) or sc.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_DIR} to a folder that every node can reach")
    app = sc.applicationId
    if app not in _local_dirs:
        _local_dirs[app] = tempfile.mkdtemp(prefix="tillframe-")
    return _local_dirs[app]


def _tables_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/tables/{spark.sparkContext.applicationId}"


def materialize(df: DataFrame, name: str, cluster_by: Sequence[str] = (), partition_by: Sequence[str] = (), sort_by: Sequence[str] = (), codec: str = "") -> DataFrame:
    """Write ``df`` under the shared folder and return a reader over the files.

    With ``partition_by`` there is a folder per value of these columns (few values).

    With ``cluster_by`` each file holds a narrow range of these columns, so that
    filters on them skip most files. End the list with columns that break ties:
    a value held by many rows is then spread over several files.

    With ``sort_by`` each file is sorted by these columns and nothing is moved for
    it: filters on them skip most pages of each file.

    ``codec`` packs long texts closer than the session's codec does.
    """
    spark = df.sparkSession
    path = f"{_tables_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    if cluster_by:
        df = df.repartitionByRange(*cluster_by).sortWithinPartitions(*cluster_by)
    if sort_by:
        df = df.sortWithinPartitions(*sort_by)
    df.write.partitionBy(*partition_by).parquet(path, compression=codec or None)
    return spark.read.schema(df.schema).parquet(path)


def broadcast_small(df: DataFrame, rows: int, name: str = "small") -> DataFrame:
    """Store ``df``, count it, and mark it for broadcast only up to ``rows`` rows."""
    stored = materialize(df, name)
    return F.broadcast(stored) if stored.count() <= rows else stored


def release(spark: SparkSession) -> None:
    """Delete the intermediate tables of this application."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_tables_dir(spark))
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


SPREAD_BYTES = 512 << 20
SMALL_BYTES = 64 << 20


def scan_bytes(df: DataFrame) -> int:
    """The size of the scans below ``df``, which Spark takes from their files."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return sum(int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size()))


def spread(scan: DataFrame) -> DataFrame:
    """Use all cores on a small table kept in a few pieces; large tables are left as they are.

    To be used on a plain scan, whose size Spark takes from its files.
    """
    size = int(scan._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if size <= SPREAD_BYTES else scan
