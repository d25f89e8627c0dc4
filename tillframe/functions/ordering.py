"""Global positions, running totals and exact quantiles without a one-task sort.

A global sort spreads rows over range partitions. Each row then keeps the number
of its partition and its place in it; one small table of per-partition totals
turns these into global values.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillframe.sources.storage import materialize

_POSITION_BITS = 33  # monotonically_increasing_id: partition number above, row below


def with_scalars(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Put the columns of a one-row table (a global aggregate) next to every row."""
    return df.crossJoin(F.broadcast(one_row))


def _sorted_by_partition(df: DataFrame, order: Sequence[Column | str], name: str) -> DataFrame:
    """Sort globally, tag rows with (partition, place) and store the result.

    Storing matters: range boundaries are sampled, so a recomputed sort could
    give other partition numbers than those the totals were taken from.
    """
    tagged = df.orderBy(*order).withColumn("_mono", F.monotonically_increasing_id())
    stored = materialize(tagged, name)
    return stored.withColumn("_part", F.shiftright("_mono", _POSITION_BITS)).withColumn(
        "_place", F.col("_mono") - F.shiftleft("_part", _POSITION_BITS)
    )


def _partition_starts(parts: DataFrame) -> DataFrame:
    """Running start per partition; one row per sort partition, so it is tiny."""
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return parts.select("_part", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_base"))


def with_position(df: DataFrame, order: Sequence[Column | str], name: str = "position") -> DataFrame:
    """Add the 0-based global position of each row under ``order`` (a unique order)."""
    rows = _sorted_by_partition(df, order, f"sorted-{name}")
    starts = _partition_starts(rows.groupBy("_part").agg(F.count("*").alias("_total")))
    return rows.join(F.broadcast(starts), "_part").select(*df.columns, (F.col("_base") + F.col("_place")).alias(name))


def with_running_total(df: DataFrame, order: Sequence[str], weight: str) -> DataFrame:
    """Add ``_start`` and ``_end``: the running total of ``weight`` before and after each row."""
    rows = _sorted_by_partition(df, order, "running")
    starts = _partition_starts(rows.groupBy("_part").agg(F.sum(weight).alias("_total")))
    upto = Window.partitionBy("_part").orderBy("_place").rowsBetween(Window.unboundedPreceding, 0)
    return (
        rows.withColumn("_run", F.sum(weight).over(upto))
        .join(F.broadcast(starts), "_part")
        .withColumn("_end", F.col("_base") + F.col("_run"))
        .withColumn("_start", F.col("_end") - F.col(weight))
        .drop("_mono", "_part", "_place", "_run", "_base")
    )


def exact_quantiles(df: DataFrame, columns: Sequence[str], probabilities: dict[str, float]) -> DataFrame:
    """Linearly interpolated quantiles: a row per column, a field per probability.

    All columns go through one sort. Equal values are counted first, so a value
    shared by a third of the rows is one row of the sort. Nulls are ignored; a
    column without values is missing from the result.
    """
    doubles = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    counts = (
        doubles.unpivot([], list(columns), "column", "_v")
        .where(F.col("_v").isNotNull())
        .groupBy("column", "_v")
        .agg(F.count("*").alias("_n"))
    )
    spans = with_running_total(counts, ["column", "_v"], "_n")
    totals = spans.groupBy("column").agg(F.sum("_n").alias("_rows"), F.min("_start").alias("_first"))
    spans = spans.join(F.broadcast(totals), "column")  # one row per column

    def value_at(rank: Column) -> Column:
        place = rank + F.col("_first")
        return F.max(F.when((F.col("_start") <= place) & (place < F.col("_end")), F.col("_v")))

    picks = []
    for name, p in probabilities.items():
        rank = (F.col("_rows") - 1) * F.lit(float(p))
        picks += [
            value_at(F.floor(rank)).alias(f"_lo_{name}"),
            value_at(F.ceil(rank)).alias(f"_hi_{name}"),
            F.max(rank - F.floor(rank)).alias(f"_frac_{name}"),
        ]
    picked = spans.groupBy("column").agg(*picks)

    def between(name: str) -> Column:
        low, high = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        return (low + (high - low) * F.col(f"_frac_{name}")).alias(name)

    # A few numbers per column, wanted next to every row: stored, so that the sort runs once.
    return materialize(picked.select("column", *[between(name) for name in probabilities]), "quantiles")


def quantile_row(df: DataFrame, wanted: dict[str, tuple[str, float]]) -> DataFrame:
    """One row of quantiles: ``wanted`` maps a name to (column, probability)."""
    columns = sorted({c for c, _ in wanted.values()})
    levels = {f"q{i}": p for i, p in enumerate(sorted({p for _, p in wanted.values()}))}
    field = {p: name for name, p in levels.items()}
    table = exact_quantiles(df, columns, levels)
    return table.agg(
        *[F.max(F.when(F.col("column") == c, F.col(field[p]))).alias(name) for name, (c, p) in wanted.items()]
    )
