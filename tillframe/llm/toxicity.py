"""Toxicity by a chain of linear classifiers, one per category.

The categories are predicted in a fixed order, and the probability of each
earlier category is an input of the later models. In training these inputs are
out-of-fold predictions, so a later model does not learn to trust an earlier
one more than it deserves. The last category is the verdict.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillframe.llm.common import prepare

LETTERS = re.compile(r"[^\W\d_]+")
PREFIXES = (4, 5)
BUCKETS = 1 << 20
TRAIN_ROWS = 3000  # bound of the labelled sample, half of it toxic where there are as many
MIN_TEXTS = 5  # a feature in fewer sample texts is not learnt
STEPS, PENALTY, REFIT, FOLDS = 100, 0.07, 0.005, 3
SETTLED = 1e-5  # a step that moves no weight by more ends the descent
CACHE = 400_000

# Weak labels: a toxic document is of a category if it has one of these words, unknown if it has none of any category.
CATEGORY_TERMS = {
    "insult": ("clown", "idiot", "loser", "moron", "stupid"),
    "degrading": ("disgusting", "pathetic", "scum", "trash", "worthless"),
}
VERDICT = "toxic"


def word_features(word: str) -> tuple[int, ...]:
    """Hashed features of a lower-case word: the word and its prefixes."""
    forms = ["=" + word] + [word[:n] for n in PREFIXES if len(word) >= n]
    return tuple(zlib.crc32(f.encode()) % BUCKETS for f in forms)


def text_features(text: str | None) -> list[int]:
    """The distinct features of a whole text; none for null."""
    found: set[int] = set()
    for word in set(LETTERS.findall((text or "").lower())):
        found.update(word_features(word))
    return sorted(found)


@dataclass
class Sample:
    """Texts of a labelled sample as sparse binary features: row and column numbers of the ones."""

    rows: np.ndarray
    cols: np.ndarray
    features: np.ndarray  # hashed feature of each column
    n_rows: int

    @classmethod
    def of(cls, lists: Sequence[Sequence[int]]) -> Sample:
        counts = np.zeros(BUCKETS, np.int32)
        for x in lists:  # the features of a text are distinct
            counts[np.asarray(x, np.int32)] += 1
        kept = np.flatnonzero(counts >= MIN_TEXTS)
        place = np.full(BUCKETS, -1, np.int32)
        place[kept] = np.arange(len(kept))
        cols = [c[c >= 0] for c in (place[np.asarray(x, np.int32)] for x in lists)]
        rows = np.repeat(np.arange(len(lists), dtype=np.int32), [len(c) for c in cols])
        return cls(rows, np.concatenate(cols) if cols else np.zeros(0, np.int32), kept, len(lists))

    def part(self, rows: np.ndarray) -> Sample:
        place = np.full(self.n_rows, -1)
        place[rows] = np.arange(len(rows))
        at = place[self.rows] >= 0
        return Sample(place[self.rows[at]], self.cols[at], self.features, len(rows))


@dataclass
class Linear:
    sparse: np.ndarray
    dense: np.ndarray
    bias: float

    def __call__(self, x: Sample, dense: np.ndarray) -> np.ndarray:
        logit = np.bincount(x.rows, self.sparse[x.cols], minlength=x.n_rows) + dense @ self.dense + self.bias
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


def fit_linear(x: Sample, dense: np.ndarray, y: np.ndarray) -> Linear:
    """Logistic regression on the features that an L1 penalty keeps, fitted again with less of it."""
    first = descend(x, dense, y, PENALTY)
    kept = np.flatnonzero(first.sparse)
    place = np.full(len(x.features), -1)
    place[kept] = np.arange(len(kept))
    at = place[x.cols] >= 0
    again = descend(Sample(x.rows[at], place[x.cols[at]], x.features[kept], x.n_rows), dense, y, REFIT)
    sparse = np.zeros(len(x.features))
    sparse[kept] = again.sparse
    return Linear(sparse, again.dense, again.bias)


def descend(x: Sample, dense: np.ndarray, y: np.ndarray, penalty: float) -> Linear:
    """Logistic regression, classes of equal weight, L1 penalty on the word features: accelerated proximal gradient.

    With one class only, the model is the constant share of that class.
    """
    n, k = len(x.features), dense.shape[1]
    if not len(y) or y.min() == y.max():
        rate = float(y.mean()) if len(y) else 0.0
        return Linear(np.zeros(n), np.zeros(k), 30.0 * (2 * rate - 1))
    share = np.where(y > 0, 0.5 / (y > 0).sum(), 0.5 / (y == 0).sum())
    # Columns of equal length: frequent words neither slow the descent down nor outweigh rare ones.
    scale = 1 / np.sqrt(np.bincount(x.cols, share[x.rows], minlength=n) + 1e-4)

    def forward(w):
        return np.bincount(x.rows, (w[:n] * scale)[x.cols], minlength=x.n_rows) + dense @ w[n : n + k] + w[-1]

    def backward(r):
        return np.concatenate([np.bincount(x.cols, r[x.rows], minlength=n) * scale, dense.T @ r, [r.sum()]])

    v = np.ones(n + k + 1)
    for _ in range(12):  # largest curvature by power iteration
        v /= np.linalg.norm(v)
        v = backward(share * forward(v))
    step = 4.0 / (1.1 * np.linalg.norm(v))
    w = np.zeros(n + k + 1)
    z, t = w, 1.0
    for _ in range(STEPS):
        slope = share * (1 / (1 + np.exp(-np.clip(forward(z), -30, 30))) - y)
        new = z - step * backward(slope)
        new[:n] = np.sign(new[:n]) * np.maximum(np.abs(new[:n]) - step * penalty, 0)
        if (z - new) @ (new - w) > 0:  # the momentum points uphill: start it anew
            t = 1.0
        grown = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z = new + (t - 1) / grown * (new - w)
        moved, w, t = float(np.abs(new - w).max()), new, grown
        if moved < SETTLED:
            break
    return Linear(w[:n] * scale, w[n : n + k], float(w[-1]))


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


@dataclass
class Chain:
    """Models in the order of the categories; ``weights`` maps a feature to its weight in each model."""

    categories: tuple[str, ...]
    weights: dict[int, np.ndarray]
    dense: list[np.ndarray]
    bias: list[float]
    threshold: float

    def probabilities(self, features) -> list[float]:
        """Of one text, given its features that have a weight."""
        sums = sum((self.weights[f] for f in features), np.zeros(len(self.categories)))
        earlier: list[float] = []
        result = []
        for k in range(len(self.categories)):
            logit = float(sums[k] + np.dot(self.dense[k], earlier) + self.bias[k]) if k else float(sums[0] + self.bias[0])
            p = 1 / (1 + np.exp(-min(30.0, max(-30.0, logit))))
            result.append(float(p))
            earlier.append(float(_logit(np.array(p))))
        return result


def fit_chain(lists: Sequence[Sequence[int]], labels: dict[str, np.ndarray]) -> Chain:
    """Fit the models in the order of ``labels``: category -> 0, 1 or NaN (not known) per text."""
    x = Sample.of(lists)
    fold = np.arange(x.n_rows) % FOLDS
    earlier = np.zeros((x.n_rows, 0))
    models, out = [], np.zeros(x.n_rows)
    for y in labels.values():
        known = ~np.isnan(y)
        out = np.zeros(x.n_rows)
        for f in range(FOLDS):
            train = np.flatnonzero(known & (fold != f))
            test = np.flatnonzero(fold == f)
            part = fit_linear(x.part(train), earlier[train], y[train])
            out[test] = part(x.part(test), earlier[test])
        rows = np.flatnonzero(known)
        models.append(fit_linear(x.part(rows), earlier[rows], y[rows]))
        earlier = np.column_stack([earlier, _logit(out)])
    last = list(labels.values())[-1]
    used = np.flatnonzero(np.any([m.sparse != 0 for m in models], axis=0))
    weights = {int(x.features[c]): np.array([m.sparse[c] for m in models]) for c in used}
    threshold = cut(out[~np.isnan(last)], last[~np.isnan(last)])
    return Chain(tuple(labels), weights, [m.dense for m in models], [m.bias for m in models], threshold)


def cut(p: np.ndarray, y: np.ndarray) -> float:
    """The threshold with the fewest errors, classes of equal weight; in the middle of its gap."""
    if not len(y) or y.min() == y.max():
        return 0.5
    order = np.argsort(p, kind="stable")
    p, y = p[order], y[order]
    missed = np.concatenate([[0], np.cumsum(y)]) / y.sum()  # toxic ones below each cut
    wrong = 1 - np.concatenate([[0], np.cumsum(1 - y)]) / (1 - y).sum()
    bounds = np.concatenate([[0.0], p, [1.0]])
    errors = np.where(np.diff(bounds) > 0, missed + wrong, np.inf)
    best = np.flatnonzero(errors <= errors.min() + 1e-12)
    widest = best[np.argmax(np.diff(bounds)[best])]
    return float((bounds[widest] + bounds[widest + 1]) / 2)


def labelled(labels: DataFrame, positive: bool, rows: int) -> DataFrame:
    """At most ``rows`` labelled ids of one class, picked by a hash of the id."""
    picked = labels.where((F.col(VERDICT) == int(positive)) & F.col("doc_id").isNotNull())
    return picked.select("doc_id", VERDICT).distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Chain:
    """Fit the chain on at most ``rows`` labelled documents (whole texts), half of them toxic.

    ``docs`` has doc_id and text, ``labels`` doc_id and toxic. Labels without a
    document are ignored. The features are made by the tasks; only those of the
    sample reach the driver.
    """
    spark = docs.sparkSession
    prepare(spark)
    half = rows // 2
    sample = labelled(labels, True, half).union(labelled(labels, False, half))
    terms = F.array(*[F.lit(t) for t in sum(CATEGORY_TERMS.values(), ())])

    @F.pandas_udf("array<int>")
    def features(texts: pd.Series) -> pd.Series:
        return pd.Series([text_features(t) for t in texts])

    @F.pandas_udf("array<string>")
    def words(texts: pd.Series) -> pd.Series:
        every = set(sum(CATEGORY_TERMS.values(), ()))
        return pd.Series([sorted(every & set(LETTERS.findall((t or "").lower()))) for t in texts])

    joined = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")  # at most ``rows`` ids
    joined = joined.dropDuplicates(["doc_id"]).select(
        "doc_id", VERDICT, features("text").alias("features"), F.array_intersect(terms, words("text")).alias("terms")
    )
    got = joined.toPandas().sort_values("doc_id", key=lambda c: [zlib.crc32(str(i).encode()) for i in c])
    toxic = got[VERDICT].to_numpy(float)
    named = [set(t) for t in got["terms"]]
    known = np.array([bool(t) for t in named], bool) | (toxic == 0)
    y = {}
    for category, of in CATEGORY_TERMS.items():
        has = np.array([not t.isdisjoint(of) for t in named], float) * toxic
        y[category] = np.where(known, has, np.nan)
    return fit_chain(list(got["features"]), y | {VERDICT: toxic})


def toxicity(chain: Chain, text: Column, spark) -> Column:
    """A struct of the probability of each category, in the order of the chain, and ``rejected``."""
    shared = spark.sparkContext.broadcast(chain)
    schema = ", ".join(f"{c} double" for c in chain.categories) + ", rejected boolean"

    @F.pandas_udf(schema)
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = shared.value
        cache: dict[str, tuple[int, ...]] = {}
        memo: dict[frozenset, list[float]] = {}
        for texts in batches:
            rows = []
            for text in texts:
                found: set[int] = set()
                for word in set(LETTERS.findall((text or "").lower())):
                    hit = cache.get(word)
                    if hit is None:
                        if len(cache) >= CACHE:
                            cache.clear()
                        hit = cache[word] = tuple(f for f in word_features(word) if f in model.weights)
                    if hit:
                        found.update(hit)
                key = frozenset(found)
                if key not in memo:
                    if len(memo) >= CACHE:
                        memo.clear()
                    memo[key] = model.probabilities(sorted(found))
                p = memo[key]
                rows.append((*p, p[-1] >= model.threshold))
            yield pd.DataFrame(rows, columns=[*model.categories, "rejected"])

    return score(text)


def score_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, a probability per category, rejected) for every row of ``docs``.

    Whole texts are read; null and empty texts have no features and get the
    probability of the bias. Without labels, or with one class only, all
    probabilities are 0 or 1 by that class and the threshold is 0.5. Repeated
    rows are scored each; an empty table gives no rows.
    """
    spark = docs.sparkSession
    chain = train(docs, labels)
    scored = docs.select("doc_id", toxicity(chain, F.col("text"), spark).alias("score"))
    return scored.select("doc_id", "score.*")


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, that are not rejected."""
    chain = train(docs, labels)
    return docs.where(~toxicity(chain, F.col("text"), docs.sparkSession).getField("rejected"))
