"""Hard negatives by the threshold algorithm over sorted lists.

All rows are cut into blocks. A block keeps, for every dimension, the list of
its rows sorted by that component. An anchor walks all lists of a block at once,
from the end that its component's sign makes best, and scores every row it meets
by the integer inner product. The scores that the components at the current
depth would give bound every row not met yet: once this bound falls strictly
below the k-th score of a window (or below the window), that window is complete.
A block meets all anchors in groups of packs; what is shuffled is the anchors
per block, the blocks per group and the k best rows of each anchor and block.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillframe.functions.ordering import with_position
from tillframe.functions.skew import join_keyed
from tillframe.llm.common import prepare
from tillframe.sources.storage import materialize

SCALE = 256  # fixed value: a component c becomes floor(SCALE * c)
POSITIVES, NEGATIVES = 5, 3
LOW, HIGH = 50, 95  # a negative's score lies between these hundredths of the positive's
BLOCK_ROWS = 8192  # rows whose lists lie in one row of the index
PACK = 128  # anchors that go to a block together
PACKS = 64  # packs that meet a block in one task
FIRST_STEP = 16  # depth of the first look at all lists; each further look goes twice as far
SAFE = 1 << 53
ANY = (-(1 << 63), (1 << 63) - 1)


def window_of(positive: int, low: int = LOW, high: int = HIGH) -> tuple[int, int]:
    """Scores s with low * positive <= 100 * s <= high * positive, both ends included; none if the first is larger."""
    return -((-low * positive) // 100), (high * positive) // 100


def scan(
    values: np.ndarray, lists: np.ndarray, anchor: np.ndarray, eligible: np.ndarray, windows: Sequence[tuple[int, int]], k: int
) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per window (low, high): (rows, scores) that hold its ``k`` best eligible rows and all that tie with the last.

    ``values`` are the integer rows of a block, ``lists[d]`` its row numbers by
    rising component d. Scores are exact: the caller's components are small
    enough for 64 bits.
    """
    size = len(values)
    found: list = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(windows)
    if not size or not eligible.any():
        return found
    used = np.flatnonzero(anchor)
    used = used if len(used) else np.zeros(1, np.int64)  # a zero anchor scores all rows alike: any list will do
    weight = anchor[used]
    rising, falling = used[weight < 0], used[weight >= 0]
    top = int(np.abs(anchor).astype(object).sum()) * int(np.abs(values).max())
    number = np.float64 if top < SAFE else np.int64  # doubles hold these sums exactly and multiply faster
    matrix, line = values.astype(number, copy=False), anchor.astype(number)

    def bound(depth: int) -> int:
        """The best score of a row that no list shows before ``depth``."""
        low = values[lists[rising, depth], rising] @ anchor[rising]
        return int(low + values[lists[falling, size - 1 - depth], falling] @ anchor[falling])

    met = np.zeros(size, bool)
    rows, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
    open_ = [w for w, (low, high) in enumerate(windows) if low <= high and bound(0) >= low]
    depth, step = 0, FIRST_STEP
    while open_:
        end = min(size, depth + step)
        seen = met.copy()
        met[lists[rising, depth:end]] = True
        met[lists[falling, size - end : size - depth]] = True
        fresh = np.flatnonzero(met & ~seen & eligible)
        rows = np.concatenate([rows, fresh])
        scores = np.concatenate([scores, (matrix[fresh] @ line).astype(np.int64)])
        limit = bound(end - 1)
        left = []
        for w in open_:
            low, high = windows[w]
            inside = np.flatnonzero((scores >= low) & (scores <= high))
            kth = np.partition(scores[inside], len(inside) - k)[len(inside) - k] if len(inside) >= k else None
            if end == size or limit < low or (kth is not None and limit < kth):
                best = inside if kth is None else inside[scores[inside] >= kth]
                found[w] = (rows[best], scores[best])
            else:
                left.append(w)
        open_, depth, step = left, end, 2 * step
    return found


def first_of(rows: np.ndarray, scores: np.ndarray, ids: np.ndarray, places: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``k``: higher scores, then smaller ids, then earlier places."""
    order = np.lexsort((places[rows], ids[rows], -scores))[:k]
    return rows[order], scores[order]


def _stack(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    whole = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return whole.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.int64)


INDEX = "dim int, block long, ids binary, places binary, labels binary, vecs binary, lists binary"


def index_blocks(rows: DataFrame, block_rows: int) -> DataFrame:
    """One row per block of ``rows`` (dim, place, vec_id, label, x): its members and their sorted lists."""

    def build(key: tuple, table: pa.Table) -> pa.Table:
        dim = key[0].as_py()
        x = _stack(table.column("x"), dim)
        lists = np.argsort(x, axis=0, kind="stable").T.astype(np.int32)
        columns = [table.column(c).to_numpy().astype(np.int64) for c in ("vec_id", "place", "label")] + [x, lists]
        cells = [pa.array([np.ascontiguousarray(c).tobytes()], pa.binary()) for c in columns]
        return pa.Table.from_arrays([pa.array([dim], pa.int32()), pa.array([key[1].as_py()], pa.int64()), *cells], [c.split()[0] for c in INDEX.split(", ")])

    numbered = rows.select("dim", F.expr(f"place div {block_rows}").alias("block"), "vec_id", "place", "label", "x")
    return numbered.groupBy("dim", "block").applyInArrow(build, INDEX)


def _unpack(table: pa.Table, dim: int) -> tuple[np.ndarray, ...]:
    ids, places, labels, vecs = (np.frombuffer(table.column(c)[0].as_py(), np.int64) for c in ("ids", "places", "labels", "vecs"))
    lists = np.frombuffer(table.column("lists")[0].as_py(), np.int32).reshape(dim, len(ids))
    return ids, places, labels, vecs.reshape(len(ids), dim), lists


def _meet(index: DataFrame, packs: DataFrame, group: int, search, schema: str) -> DataFrame:
    """``search(block, anchors)`` for each block and each pack of ``packs`` (dim, pack, block, ...) that asks for it.

    Packs are dealt out by block and group of packs, so that neither many blocks
    nor many packs end in one task.
    """
    spark = index.sparkSession
    asked = packs.withColumn("deal", F.expr(f"pack div {group}"))
    keys = ["dim", "block", "deal"]
    wanted = materialize(asked.select(*keys).distinct(), "negatives-cells")
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    left = index.join(wanted, ["dim", "block"]).repartition(parts, *keys)
    right = asked.repartition(parts, *keys)

    def task(key: tuple, block: pa.Table, anchors: pa.Table) -> pa.Table:
        names = [c.split()[0] for c in schema.split(", ")]
        out = list(search(_unpack(block, key[0].as_py()), anchors, key[0].as_py()) if block.num_rows else ())
        columns = [np.concatenate([part[c] for part in out]) if out else np.zeros(0, np.int64) for c in range(len(names))]
        return pa.Table.from_arrays([pa.array(c.astype(np.int64)) for c in columns], names)

    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(task, schema)


def _anchors(table: pa.Table, dim: int) -> Iterator[tuple]:
    """(place, label, vec_id, x, ids and scores of the positives) of each anchor of the packs."""
    for row in range(table.num_rows):
        places, labels, ids, sizes, near, scores = (
            table.column(c)[row].values.to_numpy(zero_copy_only=False) for c in ("places", "labels", "ids", "sizes", "near", "scores")
        )
        x = table.column("xs")[row].values.to_numpy(zero_copy_only=False).reshape(-1, dim)
        ends = np.cumsum(sizes)
        for k in range(len(places)):
            own = slice(ends[k] - sizes[k], ends[k])
            yield int(places[k]), int(labels[k]), int(ids[k]), x[k], near[own].tolist(), scores[own].tolist()


def _packed(anchors: DataFrame, pack: int, name: str) -> DataFrame:
    """Anchors in packs of ``pack`` by their place: (dim, pack, first, last, plain arrays of all anchors' fields)."""
    placed = with_position(anchors, ["dim", "place"], name)
    each = F.struct("place", "label", "vec_id", "x", "near", "scores")
    packs = placed.groupBy("dim", F.expr(f"{name} div {pack}").alias("pack")).agg(
        F.min("first").alias("first"), F.max("last").alias("last"), F.collect_list(each).alias("a")
    )
    flat = packs.select(
        "dim", "pack", "first", "last", F.col("a.place").alias("places"), F.col("a.label").alias("labels"), F.col("a.vec_id").alias("ids"),
        F.flatten("a.x").alias("xs"), F.transform("a.near", F.size).alias("sizes"),
        F.flatten("a.near").alias("near"), F.flatten("a.scores").alias("scores"),
    )
    return materialize(flat, "negatives-packs")


def usable(vector: Column) -> Column:
    """Not null or empty, all components finite and so small that a long holds every score."""
    limit = F.sqrt(F.lit(2.0**62) / F.size(vector)) / SCALE - 1
    sound = F.forall(vector, lambda c: c.isNotNull() & (F.abs(c.cast("double")) < limit))  # NaN is above all
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & sound, F.lit(False))


def mine_negatives(
    vectors: DataFrame,
    anchor: Column,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    block_rows: int = BLOCK_ROWS,
    pack: int = PACK,
    packs: int = PACKS,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for ``vectors`` (vec_id, label, embedding).

    ``anchor`` says which rows ask; all rows answer. Rows without id or label take no
    part, nor do rows whose vector is null or empty, holds null or non-finite
    components, or components so large that no long holds their scores. Rows
    meet rows of the same length only. A repeated row is a row like any other:
    as an anchor it asks again, as an answer it takes a place; among equal scores
    and ids the one that was sorted first comes first. An anchor without
    positives, or whose windows hold no negative, has no row. An empty table
    gives no rows.
    """
    spark = prepare(vectors.sparkSession)
    whole = F.transform("embedding", lambda c: F.floor(c.cast("double") * SCALE).cast("long"))
    asks = F.coalesce(anchor, F.lit(False))
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable(F.col("embedding"))).select(
        F.size("embedding").alias("dim"), F.col("label").cast("long").alias("label"), F.col("vec_id").cast("long").alias("vec_id"),
        whole.alias("x"), asks.alias("asks"),
    )
    rows = with_position(rows, ["dim", "label", "vec_id"], "place")
    index = materialize(index_blocks(rows, block_rows), "negatives-index")
    owner = F.concat_ws(":", "dim", "label").alias("owner")
    block = F.expr(f"place div {block_rows}")
    ranges = materialize(rows.select(owner, block.alias("b")).groupBy("owner").agg(F.min("b").alias("first"), F.max("b").alias("last")), "negatives-labels")
    asking = join_keyed(rows.where("asks").select("dim", owner, "place", "vec_id", "label", "x"), ranges, "owner").drop("owner")

    # First the positives: a pack goes to the blocks of its anchors' labels.
    none = F.array().cast("array<long>")
    first = _packed(asking.withColumn("near", none).withColumn("scores", none), pack, "turn")
    cells = first.agg(F.count("*").alias("n"), F.sum(F.col("last") - F.col("first") + 1).alias("cells")).first()
    cores = spark.sparkContext.defaultParallelism

    def group(total: int) -> int:
        """Packs per task: few while there are few of them, so that all cores have work."""
        return max(1, min(packs, total // (4 * cores)))

    def same_label(cell: tuple, table: pa.Table, dim: int) -> Iterator[tuple]:
        ids, places, labels, values, lists = cell
        for place, label, _, x, _, _ in _anchors(table, dim):
            mine = (labels == label) & (places != place)
            best = first_of(*scan(values, lists, x, mine, [ANY], positives)[0], ids, places, positives)
            yield np.full(len(best[0]), place), ids[best[0]], places[best[0]], best[1]

    asked = first.withColumn("block", F.explode(F.sequence("first", "last"))).drop("first", "last")
    hits = _meet(index, asked, group(cells.cells or 0), same_label, "place long, id long, at long, score long")
    order = Window.partitionBy("place").orderBy(F.desc("score"), "id", "at")
    kept = hits.withColumn("n", F.row_number().over(order)).where(F.col("n") <= positives)
    kept = materialize(kept, "negatives-positives")
    near = kept.groupBy("place").agg(F.sort_array(F.collect_list(F.struct("n", "id", "score"))).alias("p"))  # few per anchor
    near = near.select("place", F.col("p.id").alias("near"), F.col("p.score").alias("scores"))

    # Then the negatives: with the windows known, every pack goes to every block.
    blocks = index.agg(F.min("block").alias("low"), F.max("block").alias("high"), F.count("*").alias("n")).first()
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if blocks.n == 0:
        return spark.createDataFrame([], schema)
    known = asking.drop("first", "last").join(near, "place")
    known = known.withColumn("first", F.lit(blocks.low).cast("long")).withColumn("last", F.lit(blocks.high).cast("long"))
    second = _packed(known, pack, "turn")

    def other_label(cell: tuple, table: pa.Table, dim: int) -> Iterator[tuple]:
        ids, places, labels, values, lists = cell
        for place, label, anchor_id, x, near, near_scores in _anchors(table, dim):
            parts = scan(values, lists, x, labels != label, [window_of(p) for p in near_scores], negatives)
            for n, part in enumerate(parts):
                best = first_of(*part, ids, places, negatives)
                same = [np.full(len(best[0]), v) for v in (place, n, anchor_id, near[n], near_scores[n])]
                yield (*same, ids[best[0]], places[best[0]], best[1])

    asked = second.withColumn("block", F.explode(F.sequence("first", "last"))).drop("first", "last")
    columns = "place long, n long, anchor_id long, positive_id long, positive_score long, id long, at long, score long"
    hits = _meet(index, asked, group((cells.n or 0) * blocks.n), other_label, columns)
    order = Window.partitionBy("place", "n").orderBy(F.desc("score"), "id", "at")
    ranked = hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    return ranked.select(
        "anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )
