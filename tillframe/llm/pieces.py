"""SentencePiece encoding and decoding of merge-type (BPE) models, by backtracking.

The encoding of a text is the only chain of pieces in which each adjacent pair
is compatible: merging the characters of the two pieces anew gives these two
pieces back. The chain is found from left to right. One Aho-Corasick pass gives
the longest piece at every position; a piece that does not go with the one
before gives way to its longest prefix that is a piece, then to the one before,
and a position that no chain can pass is marked in a bitfield and not tried
again. Texts are encoded and decoded in map tasks; nothing is shuffled.
"""

from __future__ import annotations

import codecs
import hashlib
import re
from collections.abc import Callable, Iterator, Sequence
from itertools import chain as chained

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillframe.llm.common import prepare

SPACE = "▁"  # fixed value: stands for a space inside pieces
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6  # fixed values: kinds of pieces in a model file
MODEL_BYTES = 64 << 20  # models up to this size are handed to the tasks
KEPT_WORDS, KEPT_PAIRS = 1 << 18, 1 << 19  # entries a worker remembers before it forgets older ones
# Letters and other numerals, decimal digits, all other characters: each with the marks before it.
RUNS = re.compile(rf"{SPACE}*(?:[^\W\d_]+|\d|(?:[^\w{SPACE}]|_)+)|{SPACE}+")
MARKED = re.compile(rf"{SPACE}*[^{SPACE}]+|{SPACE}+")
FEW = 8  # characters looked for in every text
NEVER = float("-inf")
NOTHING: dict[str, tuple[str, ...]] = {}
KEPT_CHARS = 64  # longer words are encoded each time


def _one_byte(error: UnicodeError) -> tuple[str, int]:
    """Each byte that belongs to no character becomes one replacement character."""
    return "�", error.start + 1


codecs.register_error("tillframe-one-byte", _one_byte)


def read_model(path: str) -> dict:
    """The pieces of a model file: (piece, score, kind) by id, and what it does to a text first.

    Only merge-type models with an identity normaliser are exact here; others
    raise ValueError, as do models of more than ``MODEL_BYTES``.
    """
    from sentencepiece import sentencepiece_model_pb2

    with open(path, "rb") as file:
        data = file.read(MODEL_BYTES + 1)
    if len(data) > MODEL_BYTES:
        raise ValueError("the model file is too large to hand to every task")
    model = sentencepiece_model_pb2.ModelProto()
    model.ParseFromString(data)
    norm, train = model.normalizer_spec, model.trainer_spec
    pieces = [(p.piece, float(p.score), int(p.type)) for p in model.pieces]
    sound = train.model_type == 2 and train.byte_fallback and not train.treat_whitespace_as_suffix
    sound = sound and not norm.precompiled_charsmap and not norm.remove_extra_whitespaces and norm.escape_whitespaces
    if not sound or {k for _, _, k in pieces} - {NORMAL, UNKNOWN, CONTROL, BYTE}:
        raise ValueError("only merge-type models with byte fallback and no normalisation are supported")
    digest = hashlib.sha256(data).hexdigest()
    return {"pieces": pieces, "prefix": bool(norm.add_dummy_prefix), "unknown": train.unk_surface, "digest": digest}


class Codec:
    """Encodes texts to ids and back, exactly as the library does with the same model."""

    def __init__(self, model: dict):
        pieces = model["pieces"]
        self.prefix = model["prefix"]
        self.ids = {p: i for i, (p, _, kind) in enumerate(pieces) if kind == NORMAL}
        self.scores = {p: score for p, score, kind in pieces if kind == NORMAL}
        byte_ids = {int(p[3:-1], 16): i for i, (p, _, kind) in enumerate(pieces) if kind == BYTE}
        self.byte_ids = [byte_ids[b] for b in range(256)]
        self.matches = ahocorasick.Automaton()
        for piece in self.ids:
            self.matches.add_word(piece, piece)
        self.matches.make_automaton()
        # The longest proper prefix of a piece that is a piece: what is tried when the piece does not fit.
        self.shorter = {p: next((p[:k] for k in range(len(p) - 1, 0, -1) if p[:k] in self.ids), "") for p in self.ids}
        self.cut = self._cut()
        self.surfaces = [self._surface(p, kind, model["unknown"]) for p, _, kind in pieces]
        self.leading = [kind == NORMAL and p.startswith(SPACE) for p, _, kind in pieces]
        self.pairs: dict[str, dict[str, tuple[str, ...]]] = {}  # piece -> longest piece after it -> those that fit
        self.known = 0
        self.words: dict[str, list[int]] = {}  # word -> ids; those before the last change of generation are in older
        self.older: dict[str, list[int]] = {}

    def _cut(self) -> Callable[[str], list[str]]:
        """Cuts a text where no piece of the vocabulary leads across, so that words are encoded apart.

        Marks go with what follows them. Letters, digits and other characters
        are cut from each other in texts without the characters by which a piece
        joins them.
        """
        letters = set("".join(self.ids))
        kinds = {c: "m" if c == SPACE else "d" if c.isdecimal() else "w" if c.isalnum() else "s" for c in letters}
        pairs = {(a, b) for p in self.ids for a, b in zip(p, p[1:])}
        if any(b == SPACE != a for a, b in pairs):
            return lambda text: [text]
        odd = {a for a, b in pairs if a != SPACE and (kinds[a] != kinds[b] or kinds[a] == "d")}
        if len(odd) > FEW:
            return MARKED.findall
        return lambda text: (MARKED if any(c in text for c in odd) else RUNS).findall(text)

    @staticmethod
    def _surface(piece: str, kind: int, unknown: str) -> bytes:
        if kind == BYTE:
            return bytes([int(piece[3:-1], 16)])
        if kind == CONTROL:
            return b""
        return (unknown if kind == UNKNOWN else piece.replace(SPACE, " ")).encode()

    def merged(self, text: str) -> list[str]:
        """What merging the characters of a short text gives: best score first, leftmost on ties."""
        parts, score = list(text), self.scores.get
        gains = [score(a + b, NEVER) for a, b in zip(parts, parts[1:])]
        while gains and (best := max(gains)) > NEVER:
            at = gains.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del gains[at]
            if at:
                gains[at - 1] = score(parts[at - 1] + parts[at], NEVER)
            if at < len(gains):
                gains[at] = score(parts[at] + parts[at + 1], NEVER)
        return parts

    def fitting(self, before: str, longest: str) -> tuple[str, ...]:
        """Of a piece and its prefixes that are pieces, those compatible with the piece before, longest first.

        Two pieces are compatible if they come back when they are merged anew
        (``before`` may be empty: then the piece alone must).
        """
        if self.known >= KEPT_PAIRS:
            self.pairs.clear()
            self.known = 0
        self.known += 1
        fit, piece = [], longest
        while piece:
            if self.merged(before + piece) == ([before, piece] if before else [piece]):
                fit.append(piece)
            piece = self.shorter.get(piece, "")
        found = self.pairs.setdefault(before, {})[longest] = tuple(fit)
        return found

    def split(self, text: str) -> list[str]:
        """The pieces of a text whose spaces are marked; characters outside the vocabulary stand alone."""
        size, pairs = len(text), self.pairs
        longest = list(text)
        for end, piece in self.matches.iter(text):  # by end: of those with one start, the longest comes last
            longest[end + 1 - len(piece)] = piece
        chain: list[str] = []
        open_ = bytearray(b"\x01") * (size + 1)  # positions that a chain may still pass
        at, before = 0, ""
        while at < size:
            piece = longest[at]
            fit = pairs.get(before, NOTHING).get(piece)
            for piece in self.fitting(before, piece) if fit is None else fit:
                end = at + len(piece)
                if open_[end]:
                    chain.append(piece)
                    at, before = end, piece
                    break
            else:  # nothing fits here after the piece before: that piece was too long
                open_[at] = 0
                at -= len(chain.pop())
                before = chain[-1] if chain else ""
        return chain

    def _word(self, word: str) -> list[int]:
        known, chain = self.ids, self.split(word)
        try:
            return [known[piece] for piece in chain]
        except KeyError:  # characters outside the vocabulary become their bytes
            return [i for piece in chain for i in ([known[piece]] if piece in known else [self.byte_ids[b] for b in piece.encode()])]

    def encode(self, text: str | None) -> list[int]:
        """The ids of the whole text, without begin or end; none for a null or empty one."""
        if not text:
            return []
        text = text.replace(" ", SPACE)
        if self.prefix:
            text = SPACE + text
        ids: list[int] = []
        words = self.words
        for word in self.cut(text):
            known = words.get(word)
            if known is None:
                known = self.older.get(word) or self._word(word)
                if len(word) <= KEPT_CHARS:
                    if len(words) >= KEPT_WORDS:  # frequent words come back from the older ones
                        self.older = words
                        words = self.words = {}
                    words[word] = known
            ids += known
        return ids

    def decode(self, ids: Sequence[int]) -> str:
        """The text of any ids: bytes join to characters, the first mark of a space is dropped."""
        parts = [self.surfaces[i] for i in ids]
        if self.prefix:
            for k, i in enumerate(ids):
                if self.leading[i]:
                    parts[k] = parts[k][1:]
                    break
                if parts[k]:
                    break
        if b"" not in parts:
            return b"".join(parts).decode("utf-8", "tillframe-one-byte")
        # A piece without a text of its own still ends the bytes before it.
        ends = [k for k, part in enumerate(parts) if not part] + [len(parts)]
        runs = [parts[a:b] for a, b in zip([0, *ends], ends)]
        return "".join(b"".join(run).decode("utf-8", "tillframe-one-byte") for run in runs)


_codecs: dict[str, Codec] = {}


def _on_worker(shared) -> Codec:
    """The codec of a broadcast model, built once per worker."""
    model = shared.value
    if model["digest"] not in _codecs:
        _codecs[model["digest"]] = Codec(model)
    return _codecs[model["digest"]]


def _lists(rows: list[list[int]]) -> pa.Array:
    ends = np.cumsum([0] + [len(r) for r in rows], dtype=np.int64)
    flat = np.fromiter(chained.from_iterable(rows), np.int32, int(ends[-1]))
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat, pa.int32()))


def encoder(spark, model_path: str) -> Callable:
    """A column function text -> ids; the model file is read once, by the driver."""
    shared = spark.sparkContext.broadcast(read_model(model_path))

    @F.arrow_udf("array<int>")
    def encoded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codec = _on_worker(shared)
        for texts in batches:
            yield _lists([codec.encode(t.as_py()) for t in texts])

    return encoded


def decoder(spark, model_path: str) -> Callable:
    """A column function ids -> text; null ids give a null text."""
    shared = spark.sparkContext.broadcast(read_model(model_path))

    @F.arrow_udf("string")
    def decoded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codec = _on_worker(shared)
        for rows in batches:
            flat = rows.flatten().to_numpy(zero_copy_only=False).tolist()
            ends = np.cumsum([0, *rows.value_lengths().fill_null(0).to_pylist()])
            texts = [codec.decode(flat[a:b]) for a, b in zip(ends.tolist(), ends[1:].tolist())]
            yield pa.array(texts, pa.string(), mask=np.asarray(rows.is_null()) if rows.null_count else None)

    return decoded


def encode_documents(docs: DataFrame, model_path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` with its whole texts encoded: one more column ``ids`` (array of int).

    Null and empty texts have no ids (an empty array). Characters outside the
    vocabulary become the ids of their UTF-8 bytes. Texts of any length are
    encoded whole, in time in proportion to their length. Rows, their order and
    all other columns stay as they are; an existing column ``ids`` is replaced.
    An empty table gives no rows.
    """
    prepare(docs.sparkSession)
    return docs.withColumn(ids, encoder(docs.sparkSession, model_path)(F.col(text)))


def decode_documents(encoded: DataFrame, model_path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``encoded`` with one more column ``text``: what its ``ids`` (array of int, without nulls) stand for.

    Null ids give null, no ids the empty text; bytes that form no character
    become replacement characters, one each. An id outside the vocabulary is an
    IndexError, as in the library.
    """
    prepare(encoded.sparkSession)
    return encoded.withColumn(text, decoder(encoded.sparkSession, model_path)(F.col(ids)))
