"""Tokens, n-grams and keyword search over text columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillframe.functions.ordering import with_scalars
from tillframe.sources.storage import materialize

WORD_PATTERN = r"[\p{L}\p{N}_]{2,}"
MARK_BITS = 20  # a table of marks has 2 to this power, 128 KB


def words(text: Column) -> Column:
    """Whitespace-separated words."""
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def substrings(text: Column, size: int) -> Column:
    """All substrings of ``size`` characters, in order."""
    return F.when(
        F.length(text) >= size,
        F.transform(F.sequence(F.lit(1), F.length(text) - (size - 1)), lambda i: F.substring(text, i, F.lit(size))),
    ).otherwise(F.array().cast("array<string>"))


def char_ngrams(text: Column, low: int = 2, high: int = 4) -> Column:
    """All n-grams inside each lower-case word padded with one blank on both sides."""

    def of_word(word: Column) -> Column:
        padded = F.concat(F.lit(" "), word, F.lit(" "))
        return F.concat(*[substrings(padded, n) for n in range(low, high + 1)])

    return F.flatten(F.transform(words(F.lower(text)), of_word))


def word_tokens(text: Column) -> Column:
    """Lower-case words of two or more characters."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD_PATTERN), F.lit(0))


def token_terms(tokens: Column) -> Column:
    """Words and pairs of neighbouring words. ``tokens`` is best a column: it is named several times."""
    pairs = F.when(
        F.size(tokens) >= 2,
        F.zip_with(
            F.slice(tokens, F.lit(1), F.size(tokens) - 1),
            F.slice(tokens, F.lit(2), F.size(tokens) - 1),
            lambda a, b: F.concat(a, F.lit(" "), b),
        ),
    ).otherwise(F.array().cast("array<string>"))
    return F.concat(tokens, pairs)


def _mark_slot(word: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(word), 64 - MARK_BITS)


def marks(words_of: DataFrame, column: str) -> DataFrame:
    """One row, ``marks``: a bit per hash value, set where a word of ``column`` has that value. Its size is fixed."""
    slots = words_of.select(_mark_slot(F.col(column)).alias("slot"))
    longs = slots.groupBy(F.shiftright("slot", 6).cast("int").alias("place")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(slot & 63 as int))")).alias("bits")
    )
    every = slots.sparkSession.range(1 << (MARK_BITS - 6)).select(F.col("id").cast("int").alias("place"))
    filled = every.join(longs, "place", "left").select("place", F.coalesce("bits", F.lit(0).cast("long")).alias("bits"))
    listed = filled.agg(F.array_sort(F.collect_list(F.struct("place", "bits"))).alias("l"))
    return listed.select(F.transform("l", lambda e: e["bits"]).alias("marks"))


def is_marked(word: Column) -> Column:
    """Whether ``word`` may be among the words of ``marks``, a column beside it: true for all of them and few others."""
    slot = _mark_slot(word)
    return F.getbit(F.get("marks", F.shiftright(slot, 6).cast("int")), slot.bitwiseAND(F.lit(63)).cast("int")) == 1


def word_terms(text: Column) -> Column:
    """Lower-case words of two or more characters, and pairs of neighbouring words."""
    return token_terms(word_tokens(text))


def sorted_tokens(text: Column) -> Column:
    """The words of a name in alphabetical order, joined by single blanks."""
    return F.array_join(F.array_sort(words(text)), " ")


def name_keywords(name: Column, count: int = 3) -> Column:
    """The first words longer than three characters, quotes removed, in lower case."""
    parts = F.split(F.lower(F.replace(name, F.lit("'"), F.lit(""))), r"(?U)\s+")
    return F.slice(F.filter(parts, lambda w: F.length(w) > 3), 1, count)


def _pieces_of(token: Column, sizes: Column) -> Column:
    """The distinct substrings of ``token`` that have one of the ``sizes``."""
    return F.array_distinct(F.flatten(F.transform(sizes, lambda n: _of_size(token, n))))


def _of_size(text: Column, size: Column) -> Column:
    starts = F.sequence(F.lit(1), F.length(text) - size + 1)
    return F.when(
        F.length(text) >= size, F.transform(starts, lambda i: F.substring(text, i, size))
    ).otherwise(F.array().cast("array<string>"))


def match_keywords(texts: DataFrame, keywords: DataFrame) -> DataFrame:
    """Pairs (id, keyword) where the text contains the keyword, ignoring case.

    ``texts`` has ``id`` and ``text``, ``keywords`` has ``keyword``. A keyword
    without white space lies within one token of the text. So the distinct tokens
    of all texts are matched with the keywords once, by joining their substrings
    of the lengths that keywords have, and the texts join the tokens that hold
    one. A keyword with white space is found by its longest word, and then looked
    for in the whole text; only for such keywords the texts themselves are moved.
    Without any keyword they are not read.
    """
    wanted = keywords.select(F.lower("keyword").alias("keyword")).where("keyword <> ''").distinct()
    longest = F.try_element_at(
        F.array_sort(F.transform(words(F.col("keyword")), lambda w: F.struct(F.length(w).alias("n"), w.alias("w")))), F.lit(-1)
    )
    # A keyword of white space alone has no word; it is looked for in all texts.
    wanted = materialize(wanted.withColumn("anchor", F.coalesce(longest["w"], F.lit(""))), "keywords")
    if wanted.isEmpty():
        return texts.select("id", F.lit("").alias("keyword")).where(F.lit(False))
    anchors = wanted.select("anchor").where("anchor <> ''").distinct()
    sizes = anchors.agg(F.coalesce(F.array_sort(F.collect_set(F.length("anchor"))), F.array().cast("array<int>")).alias("sizes"))
    lowered = texts.select("id", F.lower(F.coalesce("text", F.lit(""))).alias("_text"))
    tokens = lowered.select("id", F.explode(F.array_distinct(words(F.col("_text")))).alias("token"))
    pieces = with_scalars(tokens.select("token").distinct(), sizes)
    pieces = pieces.select("token", F.explode(_pieces_of(F.col("token"), F.col("sizes"))).alias("anchor"))
    holding = pieces.join(anchors, "anchor")
    found = tokens.join(holding, "token").select("id", "anchor").distinct()
    plain = found.join(wanted.where("keyword = anchor"), "anchor").select("id", "keyword")
    spaced = wanted.where("keyword <> anchor")
    if spaced.isEmpty():
        return plain
    some = found.join(spaced.where("anchor <> ''"), "anchor").select("id", "keyword")
    checked = some.join(lowered, "id").where(F.contains("_text", "keyword")).select("id", "keyword")
    blank = spaced.where("anchor = ''").agg(F.collect_set("keyword").alias("blanks"))  # one row
    in_all = with_scalars(lowered, blank).select("id", "_text", F.explode("blanks").alias("keyword"))
    return plain.unionByName(checked).unionByName(in_all.where(F.contains("_text", "keyword")).select("id", "keyword"))
