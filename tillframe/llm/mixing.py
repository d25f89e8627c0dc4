"""Mixing sources to target weights with Efraimidis-Spirakis sampling, in DataFrame operations only.

Each source gets a budget of words. It is met by complete epochs first; what is
left is filled with documents in the order of ``-ln(u) / quality``, where ``u``
is a hash of the document: a weighted sample without replacement whose members
do not depend on partitioning.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillframe.functions.ordering import with_running_total, with_scalars
from tillframe.llm.common import WORD, prepare
from tillframe.sources.storage import materialize

WEIGHTS = (3, 1, 2)  # by rank of the source, repeating
SHARE = 1.5  # words wanted over words there
MOST_EPOCHS = 2
SEED = "mix-1"
SYMBOLS = "#$%&*+<=>@[]^_{|}~"
DIGITS = 12  # hex digits of the hash that make the uniform number


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def text_quality(text: Column) -> Column:
    """1 for plain text, down to 0.1 as a fifth of it is symbols; 1 for null and empty texts."""
    length = F.length(text)
    symbols = (length - F.length(F.translate(text, SYMBOLS, ""))) / F.nullif(length, F.lit(0))
    return F.coalesce(F.greatest(F.lit(0.1), 1 - 4.5 * symbols), F.lit(1.0))


def uniform(*parts: Column) -> Column:
    """A number in (0, 1) from a hash of the parts."""
    digest = F.md5(F.concat_ws("|", F.lit(SEED), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))
    return (F.conv(F.substring(digest, 1, DIGITS), 16, 10).cast("double") + 0.5) / F.lit(float(16**DIGITS))


def sized(docs: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """(doc_id, source, size, sample_key): the words of each document and its place in a weighted sample."""
    key = -F.log(uniform(F.col("doc_id"))) / text_quality(F.col("text"))
    size = word_count(F.col("text"))
    return docs.select("doc_id", "source", size.alias("size"), key.alias("sample_key"), *extra)


def targets(rows: DataFrame, weights: Sequence[int] = WEIGHTS) -> DataFrame:
    """(source, rank, source_size, before, target) per source of ``rows`` (source, size).

    Sources are ranked by code point, null last, and take ``weights`` in turn.
    Together they get ``SHARE`` of all words, by weight; a target stops at
    ``MOST_EPOCHS`` times the words of its source and the excess goes to the
    others by weight. All of it is integer arithmetic up to the last division.
    """
    sizes = materialize(rows.groupBy("source").agg(F.sum("size").alias("source_size")), "mix-sources")
    ranked = with_running_total(sizes.withColumn("one", F.lit(1)).withColumn("null_last", F.col("source").isNull()),
                                ["null_last", "source"], "one")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod("_start", F.lit(len(weights))) + 1).cast("int"))
    ranked = ranked.select("source", "source_size", F.col("_start").alias("rank"), weight.cast("long").alias("weight"))
    lcm = 6  # of the weights: ``level`` is the share per weight at which a source is full, times ``lcm / 2``
    ranked = materialize(ranked.withColumn("level", F.expr(f"source_size * {lcm} div weight")), "mix-ranked")
    # Words and weights of the sources that are full no later than this one.
    by_level = with_running_total(ranked, ["level", "rank"], "source_size")
    by_level = with_running_total(by_level.drop("_start").withColumnRenamed("_end", "full"), ["level", "rank"], "weight")
    total = ranked.agg(F.sum("source_size").alias("all_words"), F.sum("weight").alias("all_weight"))
    by_level = with_scalars(by_level, total)
    # Raising all shares to this level: 2 * full words + level / 3 * open weight, against 1.5 * all words; times 6.
    capped = 12 * F.col("full") + 2 * F.col("level") * (F.col("all_weight") - F.col("_end")) < 9 * F.col("all_words")
    by_level = materialize(by_level.select(*ranked.columns, "all_words", capped.alias("capped")), "mix-levels")
    left = by_level.agg(
        F.coalesce(F.sum(F.when(F.col("capped"), F.col("source_size"))), F.lit(0)).alias("capped_words"),
        F.sum(F.when(~F.col("capped"), F.col("weight"))).alias("open_weight"),
    )
    share = F.col("weight") * (3 * F.col("all_words") - 4 * F.col("capped_words")) / (2.0 * F.col("open_weight"))
    full = F.col("source_size") * float(MOST_EPOCHS)
    target = F.when(F.col("capped"), full).otherwise(F.least(share.cast("double"), full))
    wanted = with_scalars(by_level, left).select("source", "rank", "source_size", target.alias("target"))
    before = with_running_total(wanted, ["rank"], "source_size")
    return materialize(
        before.select("source", "rank", "source_size", F.col("_start").alias("before"), "target"), "mix-targets"
    )


def mix(rows: DataFrame, weights: Sequence[int] = WEIGHTS) -> DataFrame:
    """Add ``source_size``, ``target``, ``epochs``, ``extra`` and ``taken`` to ``rows`` (source, size, sample_key, ...).

    A document is taken ``epochs`` times whole, and once more (``extra`` 1) as
    long as the words taken in the order of ``sample_key`` stay within what is
    left; the document at the edge is taken if more than half of it fits. So a
    source misses its target by half a document at most, and no document is
    taken more than twice. Documents without words are taken zero words; a null
    source is a source like any other, the last. Repeated rows are taken each on
    their own. An empty table gives no rows.
    """
    plan = targets(rows, weights)
    keyed = rows.withColumn("_null", F.col("source").isNull())
    # One global sort by source and key: a source with a third of the rows is spread over many partitions.
    others = [c for c in rows.columns if c not in ("source", "sample_key")]
    running = with_running_total(keyed, ["_null", "source", "sample_key", *others], "size").drop("_null")
    plan = plan.withColumnRenamed("source", "_source").drop("rank")
    joined = running.join(plan, F.col("source").eqNullSafe(F.col("_source")))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    joined = joined.withColumn("epochs", epochs.cast("long"))
    rest = F.col("target") - F.col("epochs") * F.col("source_size")
    start = F.col("_start") - F.col("before")
    extra = (F.col("size") > 0) & (rest > 0) & (2 * (rest - start) > F.col("size"))
    joined = joined.withColumn("extra", extra.cast("long"))
    return joined.select(
        *rows.columns, "source_size", "target", "epochs", "extra",
        ((F.col("epochs") + F.col("extra")) * F.col("size")).alias("taken"),
    )


def plan_mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS) -> DataFrame:
    """``mix`` over documents (doc_id, text, source): one row per row of ``docs``."""
    prepare(docs.sparkSession)
    return mix(materialize(sized(docs), "mix-sizes"), weights)


def mixed(docs: DataFrame, weights: Sequence[int] = WEIGHTS) -> DataFrame:
    """The mix itself: rows of ``docs``, all columns, as often as they are taken.

    Texts are not sorted: the plan is made over ids and hashes and joined back.
    Equal rows are told apart by a number within their key.
    """
    prepare(docs.sparkSession)
    digest = F.xxhash64("doc_id", "source", "text")
    rows = materialize(sized(docs.withColumn("__llm_digest", digest), ["__llm_digest"]), "mix-sizes")
    plan = mix(rows, weights).select("__llm_digest", (F.col("epochs") + F.col("extra")).alias("__llm_times"))
    nth = Window.partitionBy("__llm_digest").orderBy("__llm_digest")
    plan = materialize(plan.where("__llm_times > 0"), "mix-plan").withColumn("__llm_nth", F.row_number().over(nth))
    numbered = docs.withColumn("__llm_digest", digest).withColumn("__llm_nth", F.row_number().over(nth))
    joined = numbered.join(plan, ["__llm_digest", "__llm_nth"])
    repeated = joined.withColumn("__llm_copy", F.explode(F.sequence(F.lit(1), F.col("__llm_times").cast("int"))))
    return repeated.select(*[repeated[c] for c in docs.columns])
