"""Resharding by minimum-cost flow: new capacities are met by moving as few bytes as possible.

The flow runs from the bytes of the old shards to the capacities of the new
ones; staying is free, a moved byte costs one. The graph has one node per shard,
so it is solved on the driver whatever the size of the data. Documents then
follow the flow: each old shard is cut, largest documents first, into a part
that stays and a stretch for every receiver.
"""

from __future__ import annotations

import heapq
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillframe.functions.ordering import with_running_total, with_scalars
from tillframe.llm.common import prepare
from tillframe.sources.storage import shared_dir

SHARDS, OLD_SHARDS = 8, 6
LAW = "bytes"
NOTE = "layout-"  # followed by a number: which folders hold the shards; the highest is in force


def min_cost_flow(supply: Sequence[int], capacity: Sequence[int], cost) -> dict[tuple[int, int], int]:
    """Cheapest shipment of all ``supply`` into ``capacity``: (from, to) -> amount.

    Successive shortest paths with potentials; ``cost(i, j)`` is what one unit
    costs, at least 0. The capacities must hold the supply. Ties are broken by
    the lower number, so the result is the same every time.
    """
    n, m = len(supply), len(capacity)
    left, room = list(supply), list(capacity)
    flow: dict[tuple[int, int], int] = {}
    potential = [0] * (n + m)  # sources first, then sinks
    while any(left):
        dist: list[float] = [float("inf")] * (n + m)
        back = [-1] * (n + m)
        heap = []
        for i in range(n):
            if left[i]:
                dist[i] = 0
                heapq.heappush(heap, (0, i))
        while heap:
            d, at = heapq.heappop(heap)
            if d > dist[at]:
                continue
            if at < n:
                edges = [(n + j, cost(at, j)) for j in range(m)]
            else:
                edges = [(i, -cost(i, at - n)) for i in range(n) if flow.get((i, at - n))]
            for to, c in edges:
                new = d + c + potential[at] - potential[to]
                if new < dist[to]:
                    dist[to], back[to] = new, at
                    heapq.heappush(heap, (new, to))
        reached = [(dist[n + j] + potential[n + j], j) for j in range(m) if room[j] and dist[n + j] < float("inf")]
        if not reached:
            raise ValueError("the capacities do not hold the data")
        _, j = min(reached)
        far = max(d for d in dist if d < float("inf"))
        potential = [p + min(d, far) for p, d in zip(potential, dist)]
        path, at = [], n + j
        while back[at] >= 0:
            path.append((back[at], at))
            at = back[at]
        amount = min([left[at], room[j], *[flow[(b, a - n)] for a, b in path if a >= n]])
        for a, b in path:
            key = (a, b - n) if a < n else (b, a - n)
            flow[key] = flow.get(key, 0) + (amount if a < n else -amount)
        left[at] -= amount
        room[j] -= amount
    return {k: v for k, v in sorted(flow.items()) if v}


def equal_capacities(total: int, shards: int) -> list[int]:
    return [total * (k + 1) // shards - total * k // shards for k in range(shards)]


def size_of(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def hash_shard(shards: int) -> Column:
    """The layout that is there before: by a hash of the id; rows without one are in shard 0."""
    return F.when(F.col("doc_id").isNull(), 0).otherwise(F.pmod(F.xxhash64("doc_id"), F.lit(shards))).cast("int")


def transfer_plan(rows: DataFrame, capacities: Sequence[int] | None = None, shards: int = SHARDS) -> tuple[list[int], dict]:
    """(new capacities, flow) for ``rows`` (old_shard, size). Old shard numbers are 0 and up.

    Only the bytes per old shard come to the driver: a row per shard.
    """
    sizes = {r[0]: r[1] for r in rows.groupBy("old_shard").agg(F.sum("size")).collect()}
    supply = [sizes.get(k, 0) for k in range(max([*sizes, 0]) + 1)]
    capacities = list(capacities) if capacities is not None else equal_capacities(sum(supply), shards)
    return capacities, min_cost_flow(supply, capacities, lambda i, j: int(i != j))


def reshard(rows: DataFrame, flow: dict[tuple[int, int], int], name: str = "reshard") -> DataFrame:
    """Add ``shard`` to ``rows`` (doc_id, old_shard, size, ...): documents follow the flow.

    Within an old shard the largest documents come first, and what stays comes
    first too, so that the cuts fall among small documents and a shard misses
    its capacity by about a small document per cut. A document goes where its
    middle byte goes. The order is global and range-partitioned: no shard is
    sorted by one task. Only the keys of the order are sorted, with checksums in
    place of texts; a row finds its shard by its key's place among the first
    keys behind the cuts, so texts are not shuffled. Rows equal in all columns
    stay together unless ``_file`` and ``_row`` tell them apart.
    """
    others = [c for c in rows.columns if c not in ("old_shard", "size", "doc_id")]
    texts = {f.name for f in rows.schema.fields if f.dataType.simpleString() == "string" and f.name != "_file"}
    keys = [F.col("old_shard"), -F.col("size"), F.xxhash64("doc_id"), F.col("doc_id")]
    keys += [F.crc32(F.coalesce(F.col(c).cast("binary"), F.lit(b""))) if c in texts else F.col(c) for c in others]
    key = F.struct(*[k.alias(f"_k{n}") for n, k in enumerate(keys)])
    running = with_running_total(rows.select(key.alias("_key"), "size"), ["_key"], "size")
    # Stretches of the global order: per old shard, its own part first, then the receivers.
    cuts, at = [], 0
    for i, j in sorted(flow, key=lambda k: (k[0], k[0] != k[1], k[1])):
        at += flow[(i, j)]
        cuts.append((at, j))
    middle = F.col("_start") + F.expr("size div 2")
    # At most one cut per pair of shards that is used: a row of so many keys. A cut behind all rows has none.
    behind = [F.min(F.when(middle >= end, F.col("_key"))).alias(f"_cut{n}") for n, (end, _) in enumerate(cuts[:-1])]
    shard = F.lit(cuts[-1][1] if cuts else 0)
    for n, (_, j) in reversed(list(enumerate(cuts[:-1]))):
        shard = F.when(F.col(f"_cut{n}").isNull() | (key < F.col(f"_cut{n}")), j).otherwise(shard)
    placed = with_scalars(rows, running.agg(*behind)) if behind else rows
    return placed.withColumn("shard", shard.cast("int")).select(*rows.columns, "shard")


def with_slots(placed: DataFrame) -> DataFrame:
    """Add ``slot``: gapless from 0 within each shard, by doc_id, then by the other columns."""
    others = [c for c in placed.columns if c not in ("shard", "doc_id")]
    running = with_running_total(placed.withColumn("_one", F.lit(1)), ["shard", "doc_id", *others], "_one")
    starts = running.groupBy("shard").agg(F.min("_start").alias("_first"))  # a row per shard
    joined = running.join(F.broadcast(starts), "shard")
    return joined.select(*placed.columns, (F.col("_start") - F.col("_first")).cast("long").alias("slot"))


def shard_documents(docs: DataFrame, shards: int = SHARDS, old_shards: int = OLD_SHARDS) -> DataFrame:
    """(doc_id, size, text_crc32, old_shard, shard, slot) for every row of ``docs`` (doc_id, text).

    The old layout is a hash of the id over ``old_shards``; the new one has
    ``shards`` shards of near equal bytes and moves the fewest bytes. A null text
    has size 1 and checksum 0, the empty one the same; a null doc_id is placed
    like any other; repeated rows take a slot each. Equal texts need not share a
    shard. With fewer rows than shards some shards stay empty; an empty table
    gives no rows. The old layout is stored as files of whole documents, and only
    shards that lose or gain rows are rewritten; sizes and checksums are those of
    the texts read back from the new layout.
    """
    prepare(docs.sparkSession)
    rows = docs.select("doc_id", "text", size_of(F.col("text")).alias("size"))
    folder = f"{shared_dir(docs.sparkSession)}/shards/{uuid.uuid4().hex}"
    write_shards(rows.withColumn("shard", hash_shard(old_shards)).withColumn("origin", F.col("shard")), folder)
    rewrite_affected(docs.sparkSession, folder, shards=shards)
    stored = read_shards(docs.sparkSession, folder, "doc_id long, text string, size long, origin int")
    crc = F.crc32(F.coalesce(F.col("text").cast("binary"), F.lit(b"")))
    placed = stored.select("doc_id", size_of(F.col("text")).alias("size"), crc.alias("text_crc32"), F.col("origin").alias("old_shard"), "shard")
    return with_slots(placed)


def _files(spark: SparkSession, folder: str):
    """(Hadoop's path class, file system of ``folder``)."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return path, path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def layout(spark: SparkSession, folder: str) -> dict[int, str]:
    """Shard number -> folder of its rows, as the note of the latest rewrite says. Empty shards have none."""
    path, fs = _files(spark, folder)
    notes = [f.getPath() for f in fs.listStatus(path(folder)) if f.getPath().getName().startswith(NOTE)]
    latest = max(notes, key=lambda p: int(p.getName()[len(NOTE) :]))
    lines = [r.value.split("\t") for r in spark.read.text(latest.toString()).collect()]  # a line per shard
    return {int(k): f"{folder}/{place}" for k, place in lines if place}


def _note(spark: SparkSession, folder: str, places: dict[int, str]) -> None:
    """Make ``places`` the layout of the folder: one rename, after all files are there."""
    path, fs = _files(spark, folder)
    numbers = [int(f.getPath().getName()[len(NOTE) :]) for f in fs.listStatus(path(folder)) if f.getPath().getName().startswith(NOTE)]
    text = "".join(f"{k}\t{v}\n" for k, v in sorted(places.items())) or "0\t\n"
    draft = path(f"{folder}/.{uuid.uuid4().hex}")
    out = fs.create(draft, True)
    out.write(bytearray(text.encode()))
    out.close()
    if not fs.rename(draft, path(f"{folder}/{NOTE}{max([0, *numbers]) + 1}")):
        raise OSError(f"another rewrite of {folder} was faster")
    for number in numbers:  # older notes go only when the new one is in place
        fs.delete(path(f"{folder}/{NOTE}{number}"), False)


def _write(placed: DataFrame, folder: str) -> dict[int, str]:
    """Write rows by ``shard`` into folders of their own: shard -> folder, without those of no rows."""
    spark, run = placed.sparkSession, f"rows-{uuid.uuid4().hex[:12]}"
    placed.write.partitionBy("shard").parquet(f"{folder}/{run}")
    path, fs = _files(spark, f"{folder}/{run}")
    found = [f.getPath().getName() for f in fs.listStatus(path(f"{folder}/{run}")) if f.isDirectory()]
    return {int(name[len("shard=") :]): f"{run}/{name}" for name in found if name.startswith("shard=")}


def write_shards(placed: DataFrame, folder: str) -> None:
    """Write rows with a ``shard`` column (0 and up) as one folder per shard, and a note that names the folders."""
    path, fs = _files(placed.sparkSession, folder)
    fs.mkdirs(path(folder))
    _note(placed.sparkSession, folder, _write(placed, folder))


def read_shards(spark: SparkSession, folder: str, schema: str | None = None, places_in_files: bool = False) -> DataFrame:
    """The rows of the current layout, with their ``shard``; ``schema`` says the columns if there may be no rows.

    ``places_in_files`` adds ``_file`` and ``_row``, which together tell any two rows of a shard apart.
    """
    places = sorted(layout(spark, folder).values())
    if not places:
        return spark.createDataFrame([], f"{schema}, shard int" if schema else "shard int")
    shard = F.regexp_extract(F.col("_metadata.file_path"), r"/shard=(\d+)/[^/]*$", 1).cast("int")
    rows = (spark.read.schema(schema) if schema else spark.read).parquet(*places)
    if places_in_files:
        return rows.select("*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_row"), shard.alias("shard"))
    return rows.withColumn("shard", shard)


def rewrite_affected(spark: SparkSession, folder: str, capacities: Sequence[int] | None = None, shards: int = SHARDS) -> list[int]:
    """Reshard the folder of ``write_shards`` (doc_id, size, ... by shard); returns the shards that lost or gained rows.

    Only these are rewritten, into new folders; the others keep their files. A
    shard that ends empty (fewer shards, or a capacity of 0) has no folder any
    more. One rename of a note puts the new layout in force: until then readers
    see the old one, also if the rewrite breaks off, and the replaced folders are
    deleted after it. A folder without rows stays as it is.
    """
    places = layout(spark, folder)
    if not places:
        return []
    old = read_shards(spark, folder, places_in_files=True).withColumnRenamed("shard", "old_shard")
    _, flow = transfer_plan(old, capacities, shards)
    touched = sorted({k for pair in flow if pair[0] != pair[1] for k in pair})
    if not touched:
        return []
    placed = reshard(old.where(F.col("old_shard").isin(touched)), {p: n for p, n in flow.items() if p[0] in touched})
    new = _write(placed.drop("old_shard", "_file", "_row"), folder)
    kept = {k: place[len(folder) + 1 :] for k, place in places.items() if k not in touched}
    _note(spark, folder, kept | new)
    path, fs = _files(spark, folder)
    for k in touched:
        if k in places:
            fs.delete(path(places[k]), True)
    return touched
