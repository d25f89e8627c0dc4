"""Document quality: random-indexing word vectors, pooled per document, and a small network on top.

Random indexing gives every word a sparse random index vector; the vector of a
word is the sum of the index vectors of its neighbours over the whole corpus.
Words are hashed into a fixed number of buckets, so the table of word vectors
has a fixed size whatever the corpus. A document is the mean of its word vectors
next to the mean of its index vectors. Two dense layers and a temperature,
fitted on rows that the layers have not seen, give the probability.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillframe.llm.common import prepare

TOKEN = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+")
BUCKETS, DIM, ONES = 8192, 32, 4
NEIGHBOURHOOD = 2
FLUSH = 200_000  # tokens counted at a time
CACHE = 400_000
TRAIN_ROWS = 6000  # bound of the labelled sample; half of it of the rarer label where there are as many
HIDDEN, EPOCHS, BATCH, RATE = 32, 60, 64, 0.01
CALIBRATION = 5  # every fifth row of the sample is kept for the temperature
FOLDS = 5  # the remainder 0 of the id's checksum is held out
CUT = 0.3

_rng = np.random.default_rng(20240502)
SPOTS = np.stack([_rng.permuted(np.arange(DIM))[:ONES] for _ in range(BUCKETS)])
SIGNS = _rng.choice([-1.0, 1.0], (BUCKETS, ONES))
INDEX = np.zeros((BUCKETS, DIM), np.float32)
np.put_along_axis(INDEX, SPOTS, SIGNS.astype(np.float32), axis=1)


class Buckets(dict):
    """Token -> bucket. Upper-case words and numbers are one token each; others count in lower case."""

    def __missing__(self, token: str) -> int:
        if len(self) >= CACHE:
            self.clear()
        if len(token) > 1 and token.isupper():
            form = "<upper>"
        elif token.isdigit():
            form = "<number>"
        else:
            form = token.lower()
        bucket = self[token] = zlib.crc32(form.encode()) % BUCKETS
        return bucket


def token_buckets(text: str | None, buckets: Buckets) -> np.ndarray:
    words = TOKEN.findall(text or "")
    return np.fromiter(map(buckets.__getitem__, words), np.int64, len(words))


def context_sums(docs: list[np.ndarray]) -> np.ndarray:
    """Per bucket the sum of the index vectors of its neighbours in ``docs``."""
    ids = np.concatenate(docs) if docs else np.zeros(0, np.int64)
    doc = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
    sums = np.zeros(BUCKETS * DIM)
    for gap in range(1, NEIGHBOURHOOD + 1):
        same = doc[gap:] == doc[:-gap]
        left, right = ids[:-gap][same], ids[gap:][same]
        for word, near in ((left, right), (right, left)):
            cells = (word[:, None] * DIM + SPOTS[near]).ravel()
            sums += np.bincount(cells, SIGNS[near].ravel(), minlength=BUCKETS * DIM)
    return sums.reshape(BUCKETS, DIM)


def word_vectors(docs: DataFrame) -> np.ndarray:
    """Unit context vectors of all buckets, from all texts of ``docs``.

    Every task sums over its texts and hands on at most one row per bucket; the
    rows are added by Spark, and the table that reaches the driver has
    ``BUCKETS`` rows at most.
    """
    dims = [f"d{i}" for i in range(DIM)]

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        buckets = Buckets()
        total = np.zeros((BUCKETS, DIM))
        waiting, size = [], 0
        for frame in frames:
            for text in frame["text"]:
                ids = token_buckets(text, buckets)
                for start in range(0, len(ids), FLUSH):  # a very long text goes in pieces that share their edge
                    waiting.append(ids[max(0, start - NEIGHBOURHOOD) : start + FLUSH] if start else ids[:FLUSH])
                    size += len(waiting[-1])
                    if size >= FLUSH:
                        total += context_sums(waiting)
                        waiting, size = [], 0
        total += context_sums(waiting)
        used = np.flatnonzero(total.any(1))
        yield pd.DataFrame(total[used].astype(np.int64), columns=dims).assign(bucket=used.astype(np.int32))

    schema = ", ".join(f"{d} long" for d in dims) + ", bucket int"
    sums = docs.select("text").mapInPandas(count, schema).groupBy("bucket").agg(*[F.sum(d).alias(d) for d in dims])
    got = sums.toPandas()
    vectors = np.zeros((BUCKETS, DIM))
    vectors[got["bucket"].to_numpy(int)] = got[dims].to_numpy(float)
    norm = np.linalg.norm(vectors, axis=1, keepdims=True)
    return np.divide(vectors, norm, out=vectors, where=norm > 0).astype(np.float32)


def pooled(ids: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Mean word vector and mean index vector of a document; zeros without tokens."""
    if not len(ids):
        return np.zeros(table.shape[1], np.float32)
    counts = np.bincount(ids, minlength=BUCKETS)
    used = np.flatnonzero(counts)
    return (counts[used].astype(np.float32) @ table[used]) / np.float32(len(ids))


@dataclass
class Network:
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float

    def logit(self, x: np.ndarray) -> np.ndarray:
        hidden = np.maximum(((x - self.mean) / self.scale) @ self.w1 + self.b1, 0)
        return hidden @ self.w2 + self.b2

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x) / self.temperature, -30, 30)))


def fit_network(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> Network:
    """Two layers by Adam on four fifths of the rows, the temperature on the rest.

    With one label only, or no rows, the score is the constant share of label 1
    (one half without rows).
    """
    mean = x.mean(0) if len(x) else np.zeros(x.shape[1])
    scale = x.std(0) + 1e-3 if len(x) else np.ones(x.shape[1])
    rng = np.random.default_rng(7)
    w1 = rng.standard_normal((x.shape[1], HIDDEN)) * np.sqrt(2 / x.shape[1])
    params = [w1, np.zeros(HIDDEN), rng.standard_normal(HIDDEN) * np.sqrt(1 / HIDDEN), np.zeros(1)]
    held = np.arange(len(y)) % CALIBRATION == 0
    train = np.flatnonzero(~held)
    if not len(train) or y[train].min() == y[train].max():
        rate = float(y.mean()) if len(y) else 0.5
        return Network(mean, scale, w1 * 0, params[1], params[2] * 0, 30.0 * (2 * rate - 1), 1.0)
    z = (x - mean) / scale
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    step = 0
    for epoch in range(EPOCHS):
        order = rng.permutation(train)
        for at in range(0, len(order), BATCH):
            rows = order[at : at + BATCH]
            before = z[rows] @ params[0] + params[1]
            hidden = np.maximum(before, 0)
            p = 1 / (1 + np.exp(-np.clip(hidden @ params[2] + params[3], -30, 30)))
            slope = weight[rows] * (p - y[rows]) / len(rows)
            back = np.outer(slope, params[2]) * (before > 0)
            grads = [z[rows].T @ back + 1e-4 * params[0], back.sum(0), hidden.T @ slope, np.array([slope.sum()])]
            step += 1
            rate = RATE * (1 - epoch / EPOCHS)
            for k, g in enumerate(grads):
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                params[k] = params[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    network = Network(mean, scale, params[0], params[1], params[2], float(params[3][0]), 1.0)
    rows = np.flatnonzero(held)
    logit, truth, w = network.logit(x[rows]), y[rows], weight[rows]

    def loss(temperature: float) -> float:
        s = np.clip(logit / temperature, -30, 30)
        return float((w * (np.logaddexp(0, s) - truth * s)).sum())

    network.temperature = float(min(np.exp(np.linspace(np.log(0.5), np.log(20), 80)), key=loss))
    return network


@dataclass
class Model:
    table: np.ndarray
    network: Network

    def score(self, texts, buckets: Buckets) -> np.ndarray:
        x = [pooled(token_buckets(t, buckets), self.table) for t in texts]
        return self.network.probability(np.vstack(x)) if x else np.zeros(0)


def fold(doc_id: Column) -> Column:
    """Remainder of the checksum of the id as text; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS))


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """Word vectors from all of ``docs`` (doc_id, text), the network from at most ``rows`` rows of ``labels``.

    Labels of held-out ids (``fold`` 0) are not looked at. Rows of the sample
    weigh as many labelled rows as they stand for, so the scores stay
    probabilities although the rarer label is over-represented.
    """
    spark = docs.sparkSession
    prepare(spark)
    table = np.concatenate([word_vectors(docs), INDEX], axis=1)
    known = labels.where("quality IN (0, 1) AND doc_id IS NOT NULL").where(fold(F.col("doc_id")) != 0)
    known = known.select("doc_id", "quality").distinct()
    counts = {r[0]: r[1] for r in known.groupBy("quality").count().collect()}
    half = rows // 2
    take = {q: min(counts.get(q, 0), max(half, rows - counts.get(1 - q, 0))) for q in (0, 1)}
    picked = [known.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(take[q]) for q in (0, 1)]
    shared = spark.sparkContext.broadcast(table)

    @F.pandas_udf("array<float>")
    def vector(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        buckets = Buckets()
        for texts in batches:
            yield pd.Series([pooled(token_buckets(t, buckets), shared.value) for t in texts])

    sample = F.broadcast(picked[0].union(picked[1]))  # at most ``rows`` ids
    sample = docs.select("doc_id", "text").join(sample, "doc_id").dropDuplicates(["doc_id", "quality"])
    got = sample.select("doc_id", "quality", vector("text").alias("x")).toPandas()
    got = got.iloc[np.argsort([zlib.crc32(f"{a}/{b}".encode()) for a, b in zip(got["doc_id"], got["quality"])], kind="stable")]
    x = np.vstack(got["x"]).astype(float) if len(got) else np.zeros((0, 2 * DIM))
    y = got["quality"].to_numpy(float)
    stands = np.array([counts.get(q, 0) / max(1, take[q]) for q in (0, 1)])
    weight = stands[y.astype(int)]
    return Model(table, fit_network(x, y, weight / weight.mean() if len(weight) else weight))


def quality(model: Model, text: Column, spark) -> Column:
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        buckets = Buckets()
        for texts in batches:
            yield pd.Series(shared.value.score(texts, buckets))

    return score(text)


def score_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs`` (doc_id, text).

    The score is the probability of label 1, from the whole text alone; null and
    empty texts get the score of a document without words. Without labels every
    score is one half; with one label only, 0 or 1. A null doc_id is scored like
    any other and never learnt from. Repeated rows are scored each; an empty
    table gives no rows.
    """
    model = train(docs, labels)
    scored = docs.select("doc_id", quality(model, F.col("text"), docs.sparkSession).alias("score"))
    return scored.select(
        "doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted")
    )
