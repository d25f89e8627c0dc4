"""Lengths of weighted texts by words and word pairs, without a shuffled row per text and term.

A term is known by a 64-bit key within its share, of two independent hashes of its
words. A task packs the terms of a batch of texts into one row of plain arrays per
share; all rows of a share meet in one task, which counts the texts that hold a
term and hands on a sum per text; the sums of a batch then meet.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

SHARE_CHARS = 48_000_000  # characters of text per share: about 16 million terms of texts, held by one task
BATCH_WORDS = 1 << 21  # a batch ends with the text that goes beyond

_FIRST, _SECOND = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03)
_STEPS = ((np.uint64(30), np.uint64(0xBF58476D1CE4E5B9)), (np.uint64(27), np.uint64(0x94D049BB133111EB)))

Batches = Iterator[pa.RecordBatch]


def hashed(tokens: Column) -> Column:
    """Two hashes of each word: for the key of a term, and for its share."""
    return F.transform(tokens, lambda t: F.struct(F.xxhash64(t).alias("key"), F.hash(t).alias("part")))


def squared_lengths(texts: DataFrame, elsewhere: DataFrame, total: int, chars: int, share_chars: int = SHARE_CHARS) -> DataFrame:
    """(doc, ww): the sum of ``(tf * idf) ** 2`` over all words and word pairs of each ``doc``.

    ``texts`` has one row per ``doc``, in a fixed order within each partition, with ``texts``:
    the ``hashed`` words of each of its texts. ``tf`` counts in all of them; for ``idf``
    every text counts, and as many as ``members`` of ``elsewhere``, which has the ``hashed`` words of
    a term as ``tokens``. ``total`` is the number of all texts, ``chars`` about that of their characters.
    """
    shares = max(1, -(-chars // share_chars))
    list_of = ArrayType(texts.schema["doc"].dataType).simpleString()
    schema = f"share int, chunk long, size int, docs {list_of}, keys binary, holders binary, places binary, uses binary, held binary"
    of_texts = texts.select("doc", "texts").mapInArrow(lambda b: _pack_texts(b, shares), schema)
    of_others = elsewhere.select("tokens", "members").mapInArrow(lambda b: _pack_others(b, shares), "share int, keys binary, held binary")
    packed = of_texts.unionByName(of_others, allowMissingColumns=True).repartitionById(shares, F.col("share"))
    sums = packed.mapInArrow(lambda b: _weigh(b, total), f"chunk long, docs {list_of}, sums binary")
    doc = texts.schema["doc"].dataType.simpleString()
    return sums.repartition("chunk").mapInArrow(_add, f"doc {doc}, ww double")


def _small(numbers: np.ndarray) -> bytes:
    """Numbers from 0 on as bytes, of the smallest type that holds them all."""
    return numbers.astype(np.min_scalar_type(numbers.max())).tobytes()


def _numbers(buffer: bytes, count: int) -> np.ndarray:
    return np.frombuffer(buffer, f"u{len(buffer) // count}").astype(np.int64)


def _changes(values: np.ndarray) -> np.ndarray:
    return np.concatenate([[True], values[1:] != values[:-1]])


def _lengths(lists: pa.ListArray) -> np.ndarray:
    return lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)


def _hashes(tokens: pa.StructArray) -> tuple[np.ndarray, np.ndarray]:
    key, part = (c.to_numpy(zero_copy_only=False) for c in tokens.flatten())
    return key.astype(np.int64).view(np.uint64), part.astype(np.int64).view(np.uint64)


def _pairs(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """A hash of each pair of neighbours, from the hashes of both."""
    x = left * _FIRST + right * _SECOND
    for shift, factor in _STEPS:
        x = (x ^ (x >> shift)) * factor
    return x ^ (x >> np.uint64(31))


def _by_share(keys: np.ndarray, parts: np.ndarray, shares: int) -> tuple[np.ndarray, np.ndarray]:
    """The order by share and key, equal ones as they came, and the shares in that order."""
    share = (parts % np.uint64(shares)).astype(np.min_scalar_type(shares))
    order = np.argsort(keys, kind="stable")
    order = order[np.argsort(share[order], kind="stable")]
    return order, share[order]


def _cut(batches: Batches) -> Batches:
    """The batches, those of many words in several pieces."""
    for batch in batches:
        texts = batch.column("texts")
        doc_of = np.repeat(np.arange(len(texts)), _lengths(texts))
        words = np.bincount(doc_of, weights=_lengths(texts.flatten()), minlength=len(texts))
        starts = np.flatnonzero(_changes((np.cumsum(words) - words) // BATCH_WORDS)) if len(texts) else []
        for start, end in zip(starts, [*starts[1:], len(texts)]):
            yield batch.slice(start, end - start)


def _pack_texts(batches: Batches, shares: int) -> Batches:
    """A row per batch and share: its ``keys``, the number of ``holders`` of each, and per holder its
    place in the batch, how often it uses the term and in how many of its texts. One more row has the docs of the batch."""
    for number, batch in enumerate(_cut(batches)):
        doc, texts = batch.column("doc"), batch.column("texts")
        words = texts.flatten()
        doc_of = np.repeat(np.arange(len(texts)), _lengths(texts))
        text = np.repeat(np.arange(len(words)), _lengths(words))
        key, part = _hashes(words.flatten())
        near = np.flatnonzero(text[1:] == text[:-1])
        keys = np.concatenate([key, _pairs(key[near], key[near + 1])])
        parts = np.concatenate([part, _pairs(part[near], part[near + 1])])
        text = np.concatenate([text, text[near]])
        if not len(keys):
            continue
        order, share = _by_share(keys, parts, shares)
        keys, text = keys[order], text[order]
        place = doc_of[text]
        new_term = _changes(keys) | _changes(share)
        starts = np.flatnonzero(new_term | _changes(place))  # of the holders
        uses = np.diff(np.append(starts, len(keys)))
        held = np.add.reduceat((new_term | _changes(text)).astype(np.int64), starts)
        terms = np.flatnonzero(new_term[starts])  # the first holder of each term
        keys, share, place = keys[starts][terms], share[starts][terms], place[starts]
        first = np.append(terms, len(starts))
        holders = np.diff(first)
        found, begin = np.unique(share, return_index=True)
        spans = [(a, b, first[a], first[b]) for a, b in zip(begin, np.append(begin[1:], len(terms)))]
        chunk, lists = (TaskContext.get().partitionId() << 32) + number, pa.list_(doc.type)
        rows = {
            "keys": [keys[a:b].tobytes() for a, b, _, _ in spans],
            "holders": [_small(holders[a:b]) for a, b, _, _ in spans],
            "places": [_small(place[c:d]) for _, _, c, d in spans],
            "uses": [_small(uses[c:d]) for _, _, c, d in spans],
            "held": [_small(held[c:d]) for _, _, c, d in spans],
        }
        many = len(spans)
        whole = {"share": pa.array(found.astype(np.int32)), "chunk": pa.array([chunk] * many, pa.int64()), "size": pa.array([len(texts)] * many, pa.int32())}
        yield pa.RecordBatch.from_pydict(whole | {"docs": pa.nulls(many, lists)} | {k: pa.array(v, pa.binary()) for k, v in rows.items()})
        own = {"share": pa.array([number % shares], pa.int32()), "chunk": pa.array([chunk], pa.int64()), "size": pa.array([len(texts)], pa.int32())}
        listed = pa.ListArray.from_arrays(pa.array([0, len(doc)], pa.int32()), doc)
        yield pa.RecordBatch.from_pydict(own | {"docs": listed} | {k: pa.nulls(1, pa.binary()) for k in rows})


def _pack_others(batches: Batches, shares: int) -> Batches:
    """A row per batch and share: the ``keys`` of its terms, and by how many texts each is ``held``."""
    for batch in batches:
        if not batch.num_rows:
            continue
        tokens = batch.column("tokens")
        size, members = _lengths(tokens), batch.column("members").to_numpy(zero_copy_only=False)
        start, two = np.cumsum(size) - size, size == 2
        key, part = (np.where(two, _pairs(h[start], h[start + two]), h[start]) for h in _hashes(tokens.flatten()))
        order, share = _by_share(key, part, shares)
        key, members = key[order], members[order]
        found, begin = np.unique(share, return_index=True)
        spans = list(zip(begin, np.append(begin[1:], len(key))))
        rows = {"keys": [key[a:b].tobytes() for a, b in spans], "held": [_small(members[a:b]) for a, b in spans]}
        yield pa.RecordBatch.from_pydict({"share": pa.array(found.astype(np.int32))} | {k: pa.array(v, pa.binary()) for k, v in rows.items()})


def _weigh(batches: Batches, total: int) -> Batches:
    """Over all rows of a share: a row per batch of texts with the ``sums`` of its docs, and the rows with its docs as they are."""
    terms, held, texts = [], [], []
    for batch in batches:
        with_docs = batch.column("docs").is_valid()
        own = batch.filter(with_docs)
        lists = batch.column("docs").type
        if own.num_rows:
            yield pa.RecordBatch.from_pydict({"chunk": own.column("chunk"), "docs": own.column("docs"), "sums": pa.nulls(own.num_rows, pa.binary())})
        for row in batch.filter(batch.column("docs").is_null()).drop_columns(["docs"]).to_pylist():
            terms.append(np.frombuffer(row["keys"], np.uint64))
            count = len(terms[-1])
            if row["chunk"] is None:
                held.append(_numbers(row["held"], count))
                texts.append((count, None, None, None, None, None))
                continue
            holders = _numbers(row["holders"], count)
            held.append(np.add.reduceat(_numbers(row["held"], holders.sum()), np.cumsum(holders) - holders))
            texts.append((count, row["chunk"], row["size"], row["holders"], row["places"], row["uses"]))
    if not terms:
        return
    idf = _idf(np.concatenate(terms), np.concatenate(held), total)
    del terms, held
    end = 0
    for count, chunk, size, holders, places, uses in texts:
        end += count
        if chunk is None:
            continue
        holders = _numbers(holders, count)
        all_held = holders.sum()
        weights = np.repeat(idf[end - count : end], holders) * _numbers(uses, all_held)
        sums = np.bincount(_numbers(places, all_held), weights=weights * weights, minlength=size)
        yield pa.RecordBatch.from_pydict(
            {"chunk": pa.array([chunk], pa.int64()), "docs": pa.nulls(1, lists), "sums": pa.array([sums.tobytes()], pa.binary())}
        )


def _idf(keys: np.ndarray, held: np.ndarray, total: int) -> np.ndarray:
    """For each of ``keys`` the idf by the sum of ``held`` over all its rows."""
    order = np.argsort(keys)
    starts = np.flatnonzero(_changes(keys[order]))
    each = np.log((1 + total) / (1 + np.add.reduceat(held[order], starts))) + 1
    idf = np.empty(len(keys))
    idf[order] = np.repeat(each, np.diff(np.append(starts, len(keys))))
    return idf


def _add(batches: Batches) -> Batches:
    """The sums of all shares, put to the docs of their batch."""
    docs, sums = {}, {}
    for batch in batches:
        for i, (chunk, part) in enumerate(zip(batch.column("chunk").to_pylist(), batch.column("sums").to_pylist())):
            if part is None:
                docs[chunk] = batch.column("docs")[i].values
            else:
                sums[chunk] = sums.get(chunk, 0) + np.frombuffer(part, np.float64)
    for chunk, total in sums.items():
        yield pa.RecordBatch.from_pydict({"doc": docs[chunk], "ww": pa.array(total)})
