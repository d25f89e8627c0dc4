"""Joining a fact table to a keyed table when a few keys hold most of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillframe.functions.ordering import with_scalars

BROADCAST_ROWS = 200_000
HOT_SHARE = 1 / 500
SALTS = 32


def hot_keys(df: DataFrame, key: str, share: float = HOT_SHARE) -> DataFrame:
    """Keys holding more than ``share`` of all rows: never more than ``1 / share`` of them."""
    counts = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n"))
    total = counts.agg(F.sum("_n").alias("_all"))
    return with_scalars(counts, total).where(F.col("_n") > F.col("_all") * share).select(key)


def join_keyed(
    facts: DataFrame,
    keyed: DataFrame,
    key: str,
    how: str = "left",
    keyed_rows: int | None = None,
    broadcast_rows: int = BROADCAST_ROWS,
    salts: int = SALTS,
    keys_of: DataFrame | None = None,
) -> DataFrame:
    """Join ``facts`` to ``keyed`` (one row per key), safe against hot keys.

    ``keyed_rows`` is the known row count of ``keyed``. Up to ``broadcast_rows``
    it is broadcast and the facts are not shuffled at all. Beyond that, rows of
    hot keys are spread over ``salts`` shuffle keys and only the matching keyed
    rows are repeated; all other rows join on the plain key. Hot keys are counted in
    ``keys_of`` where it is given: a scan with about the same keys as the facts, so
    that joins behind the facts do not run for the count as well.
    """
    if keyed_rows is None:
        keyed_rows = keyed.count()
    if keyed_rows <= broadcast_rows:
        return facts.join(F.broadcast(keyed), key, how)
    left, right = _salted(facts, keyed, key, salts, facts if keys_of is None else keys_of, facts.columns)
    return left.join(right, [key, "_salt"], how).drop("_salt")


def _salted(
    facts: DataFrame, keyed: DataFrame, key: str, salts: int, keys_of: DataFrame, salt_by: Sequence[str]
) -> tuple[DataFrame, DataFrame]:
    """Both sides with ``_salt``: rows of hot keys are spread by ``salt_by``, their keyed rows repeated."""
    hot = F.broadcast(hot_keys(keys_of, key).withColumn("_hot", F.lit(True)))
    # The salt is a function of the row, so a recomputed task sends rows to the same place.
    # Rows without a key find no partner, so they may go anywhere.
    salt = F.pmod(F.xxhash64(*salt_by), F.lit(salts).cast("long"))
    loose = F.col("_hot") | F.col(key).isNull()
    left = facts.join(hot, key, "left").withColumn("_salt", F.when(loose, salt).otherwise(F.lit(0).cast("long")))
    copies = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    right = keyed.join(hot, key, "left").withColumn("_salt", F.explode(copies.cast("array<long>")))
    return left.drop("_hot"), right.drop("_hot")


def join_totals(
    rows: DataFrame,
    by: Sequence[str],
    totals: Sequence[Column],
    keyed: DataFrame,
    key: str,
    keyed_rows: int | None = None,
    broadcast_rows: int = BROADCAST_ROWS,
    salts: int = SALTS,
) -> DataFrame:
    """``rows`` summed to ``totals`` per ``by``, which includes ``key``, and joined to ``keyed`` with ``how="left"``.

    As ``join_keyed`` of the sums. Beyond ``broadcast_rows`` the rows move once, to
    their key and salt, and are summed and joined there; the salt is one of the
    other columns of ``by``, so the rows of a sum stay together.
    """
    if keyed_rows is None:
        keyed_rows = keyed.count()
    if keyed_rows <= broadcast_rows:
        return join_keyed(rows.groupBy(*by).agg(*totals), keyed, key, "left", keyed_rows, broadcast_rows)
    left, right = _salted(rows, keyed, key, salts, rows, [c for c in by if c != key])
    sums = left.repartition(key, "_salt").groupBy(*by, "_salt").agg(*totals)
    return sums.join(right, [key, "_salt"], "left").drop("_salt")
