"""Benchmark items inside training texts: BM25 over an inverted index of the items, block-max WAND, then overlap.

The index holds the benchmark, the queries are the passages of the training
texts: overlapping windows that cover every word of every text. A score is
divided by the score an item gives to itself, so that one threshold holds for
all items. Retrieval is exact: every item at or above the threshold is found.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import repeat
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillframe.llm.common import prepare
from tillframe.sources.storage import materialize

TOKEN = re.compile(r"\w+")
K1, B = 1.2, 0.75
SEGMENT = 64  # words of an item indexed as one entry; a window of two segments, moved by one, covers it whole
THRESHOLD = 0.6  # share of an entry's own score
SHINGLE, OVERLAP = 5, 0.8
POSTING_BLOCK = 16
RANGES = 64  # ranges of entries with a bound of their own
ITEM_BLOCK, ITEM_BYTES = 20_000, 32 << 20  # benchmark rows and bytes indexed at a time

HIT = "array<struct<item_id: long, score: double, question_overlap: double, answer_overlap: double, item_overlap: double>>"


def tokens(text: str | None) -> list[str]:
    return TOKEN.findall((text or "").lower())


def shingles(words: list[str]) -> set[str]:
    n = min(SHINGLE, len(words))
    return {" ".join(words[i : i + n]) for i in range(len(words) - n + 1)} if n else set()


def question_answer(text: str) -> tuple[list[str], list[str]]:
    """The last sentence or line is the answer; of a single sentence, the last third of its words."""
    parts = [w for w in map(tokens, re.split(r"(?<=[.!?])\s+|\n+", text)) if w]
    if len(parts) > 1:
        return sum(parts[:-1], []), parts[-1]
    words = parts[0] if parts else []
    at = len(words) - len(words) // 3
    return words[:at], words[at:]


def entries_of(words: list[str]) -> list[Counter]:
    """The word counts of the overlapping segments that an item is indexed by."""
    starts = list(range(0, max(1, len(words) - SEGMENT + 1), SEGMENT // 2))
    if starts[-1] + SEGMENT < len(words):
        starts.append(len(words) - SEGMENT)
    return [Counter(words[s : s + SEGMENT]) for s in starts]


class Statistics(NamedTuple):
    """What scores depend on, over all entries of the benchmark: their number, their words, entries per word."""

    entries: int
    words: int
    found: dict[str, int]


class Index:
    """Inverted index of benchmark entries with list-wide and block-wide maxima."""

    def __init__(self, items: list[tuple[int | None, str | None]], statistics: Statistics | None = None):
        self.items = [(i, *question_answer(t)) for i, t in items if tokens(t)]
        pieces = [(sum(e.values()), at, e) for at, (_, q, a) in enumerate(self.items) for e in entries_of(q + a)]
        pieces.sort(key=lambda p: p[0])  # entries of like length have like weights: tighter bounds per block
        entries = [e for _, _, e in pieces]
        self.item_of = [at for _, at, _ in pieces]
        df = Counter(t for e in entries for t in e)
        n = len(entries)
        total, all_words, df_all = statistics or (n, sum(p[0] for p in pieces), df)
        mean = all_words / total if total else 1.0
        self.terms = {t: i for i, t in enumerate(sorted(df))}
        idf = {t: math.log(1 + (total - df_all[t] + 0.5) / (df_all[t] + 0.5)) for t in df}
        postings: list[list[tuple[int, float]]] = [[] for _ in self.terms]
        for at, e in enumerate(entries):
            length = K1 * (1 - B + B * sum(e.values()) / mean)
            weight = {t: idf[t] * c * (K1 + 1) / (c + length) for t, c in e.items()}
            own = sum(weight.values())
            for t, w in weight.items():
                postings[self.terms[t]].append((at, w / own))
        self.docs = [[d for d, _ in p] for p in postings]
        self.weights = [[w for _, w in p] for p in postings]
        cuts = [range(0, len(p), POSTING_BLOCK) for p in postings]
        self.block_last = [[p[min(c + POSTING_BLOCK, len(p)) - 1][0] for c in r] for p, r in zip(postings, cuts)]
        self.block_max = [[max(w for _, w in p[c : c + POSTING_BLOCK]) for c in r] for p, r in zip(postings, cuts)]
        self.most = [max(w) for w in self.weights]
        # Most weight of each term within each range of entries; the last row is for unknown words.
        self.span = max(1, -(-n // RANGES))
        self.range_max = np.zeros((len(postings) + 1, -(-n // self.span) if n else 1), np.float32)
        for t, p in enumerate(postings):
            for d, w in p:
                self.range_max[t, d // self.span] = max(self.range_max[t, d // self.span], w)
        self.question = [shingles(q) for _, q, _ in self.items]
        self.answer = [shingles(a) for _, _, a in self.items]
        self.whole = [shingles(q + a) for _, q, a in self.items]

    def retrieve(self, terms: list[int], threshold: float, first: int, last: int) -> list[tuple[int, float]]:
        """Block-max WAND: (entry, score) of the entries from ``first`` to before ``last`` with ``threshold`` or more."""
        least = threshold - 1e-9
        most = self.most
        at = dict.fromkeys(terms, 0)
        found = []

        def advance(cursors: list[tuple[int, int]], to: int) -> list[tuple[int, int]]:
            moved = []
            for _, t in cursors:
                docs = self.docs[t]
                k = at[t] = bisect_left(docs, to, at[t])
                if k < len(docs) and docs[k] < last:
                    moved.append((docs[k], t))
            return moved

        open_ = sorted(advance([(0, t) for t in terms], first))
        while open_:
            total, pivot = 0.0, -1
            for k, (_, t) in enumerate(open_):
                total += most[t]
                if total >= least:
                    pivot = k
                    break
            if pivot < 0:
                break
            doc = open_[pivot][0]
            while pivot + 1 < len(open_) and open_[pivot + 1][0] == doc:
                pivot += 1
            head, tail = open_[: pivot + 1], open_[pivot + 1 :]
            bound, end = 0.0, tail[0][0] if tail else math.inf
            for _, t in head:
                block = bisect_left(self.block_last[t], doc)
                if block < len(self.block_last[t]):
                    bound += self.block_max[t][block]
                    end = min(end, self.block_last[t][block] + 1)
            if bound < least:
                if end is math.inf:
                    break
                open_ = sorted(advance(head, max(end, doc + 1)) + tail)
            elif head[0][0] == doc:
                score = sum(self.weights[t][at[t]] for _, t in head)
                if score >= least:
                    found.append((doc, score))
                open_ = sorted(advance(head, doc + 1) + tail)
            else:
                open_ = sorted(advance(head, doc) + tail)
        return found

    def hits(self, text: str | None, threshold: float, overlap: float) -> list[tuple]:
        """(item id, score, overlap of question, of answer, of the whole item) of the items inside ``text``, each once."""
        if not self.items:
            return []
        words = tokens(text)
        n = len(words)
        unknown = len(self.terms)
        ids = np.fromiter(map(self.terms.get, words, repeat(unknown)), np.int64, n)
        # Distinct words of each stretch of ``SEGMENT`` words; a window is two stretches.
        stretch = np.unique((np.arange(n) // SEGMENT) * (unknown + 1) + ids)
        stretch = stretch[stretch % (unknown + 1) < unknown]
        place, term = np.divmod(stretch, unknown + 1)
        count = -(-n // SEGMENT)
        bound = np.zeros((count + 1, self.range_max.shape[1]), np.float32)
        if len(place):
            firsts = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
            bound[place[firsts]] = np.add.reduceat(self.range_max[term], firsts, axis=0)
        # Looser than the exact bound by what single precision may lose.
        open_windows = np.argwhere(bound[:-1] + bound[1:] >= threshold - 1e-3)
        best: dict[int, tuple] = {}
        for k, r in open_windows.tolist():
            a, b = k * SEGMENT, min((k + 2) * SEGMENT, n)
            known = np.unique(term[np.searchsorted(place, k) : np.searchsorted(place, k + 2)]).tolist()
            for entry, score in self.retrieve(known, threshold, r * self.span, (r + 1) * self.span):
                item = self.item_of[entry]
                _, q, c = self.items[item]
                reach = len(q) + len(c)
                near = " " + " ".join(words[max(0, a - reach) : b + reach]) + " "
                part, told, whole = (
                    sum(f" {s} " in near for s in group) / len(group) if group else 1.0
                    for group in (self.question[item], self.answer[item], self.whole[item])
                )
                # Shorter items are one run of words: their parts say nothing.
                if whole >= overlap or (reach >= SHINGLE and part >= overlap and told >= overlap):
                    best[item] = max(best.get(item, (0.0, 0.0, 0.0, 0.0)), (score, part, told, whole))
        return [(self.items[i][0], *v) for i, v in sorted(best.items())]


def statistics_of(rows: DataFrame) -> tuple[DataFrame, int, int]:
    """(entries per word, all entries, all their words) of all items, counted by Spark."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            entries = [e for t in batch["text"] for e in entries_of(tokens(t)) if e]
            found = Counter(w for e in entries for w in e)
            words = sum(sum(e.values()) for e in entries)
            # A word is never null: that row holds the totals.
            yield pd.DataFrame({"word": [None, *found], "n": [len(entries), *found.values()], "words": [words, *[0] * len(found)]})

    parts = rows.select("text").mapInPandas(count, "word string, n long, words long")
    table = materialize(parts.groupBy("word").agg(F.sum("n").alias("n"), F.sum("words").alias("words")), "benchmark-words")
    total = table.where("word IS NULL").first()
    return table.where("word IS NOT NULL"), *((total.n, total.words) if total else (0, 0))


def indexes(items: DataFrame) -> Iterator[Index]:
    """Indexes of blocks of the benchmark (item_id, text), each about ``ITEM_BLOCK`` rows and ``ITEM_BYTES`` on average.

    A block is all that passes through the driver at a time. Scores depend on
    the whole benchmark, not on the blocks: each is built with the statistics of
    all items, of which it gets those of its own words.
    """
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), "text")
    n, size = rows.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    blocks = max(1, math.ceil(n / ITEM_BLOCK), math.ceil(size / ITEM_BYTES))
    if blocks == 1:
        yield Index([(r.item_id, r.text) for r in rows.orderBy("item_id", "text").collect()])
        return
    table, entries, words = statistics_of(rows)
    for b in range(blocks):
        part = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).orderBy("item_id", "text").collect()
        own = sorted({w for r in part for w in tokens(r.text)})
        known = table.join(items.sparkSession.createDataFrame([(w,) for w in own], "word string"), "word")
        yield Index([(r.item_id, r.text) for r in part], Statistics(entries, words, {r.word: r.n for r in known.collect()}))


def _search(shared, threshold: float, overlap: float):
    """A column function over one broadcast block of the benchmark, whose size is bounded above."""

    @F.pandas_udf(HIT)
    def search(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        index = shared.value
        for texts in batches:
            yield pd.Series([index.hits(t, threshold, overlap) for t in texts], dtype=object)

    return search


def _searches(items: DataFrame, threshold: float, overlap: float) -> Iterator[Callable]:
    """A column function per block of the benchmark; a block is gone from the cluster when the next one is asked for."""
    spark = items.sparkSession
    prepare(spark)
    for index in indexes(items):
        shared = spark.sparkContext.broadcast(index)
        yield _search(shared, threshold, overlap)
        shared.unpersist()


def contamination(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP) -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap, item_overlap) for every benchmark item inside a document.

    ``docs`` has doc_id and text, ``items`` item_id and text. Words are runs of
    word characters in lower case, so case, punctuation and line breaks do not
    hide an item. An item counts as leaked if a window scores ``threshold`` or
    more and around it occur the five-word shingles of the whole item to
    ``overlap``, or those of its question and of its answer to ``overlap`` each. An
    item of fewer than five words counts if its words occur as one run. Null and
    empty texts and items hold and match nothing. Repeated rows of ``docs`` report
    each; equal items report each under their id. An empty side gives no rows.
    The hits of each block of a large benchmark are stored before the next block.
    """
    found = []
    for search in _searches(items, threshold, overlap):
        hits = docs.select("doc_id", F.explode(search("text")).alias("hit")).select("doc_id", "hit.*")
        found.append(materialize(hits, "leaks"))
    return reduce(DataFrame.union, found)


def drop_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, without a benchmark item inside."""
    for search in _searches(items, THRESHOLD, OVERLAP):
        docs = materialize(docs.where(F.size(search(F.col("text"))) == 0), "clean")
    return docs
