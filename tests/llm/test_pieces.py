"""Encoding and decoding against the library itself, the chain against plain merging, defined edge cases."""

from __future__ import annotations

import random

import duckdb
import public_tokenizers
import pytest
import sentencepiece

from tillframe.llm import pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")
HARD = [
    "", " ", "  ", "   ", "a", " a", "a ", "  a  b ", "\t a\n\nb\r\n", "▁", "▁a ▁ b▁", "<s></s><unk> <0x0A>", "é́ \xa0 x", "一二三 😀👩‍👩‍👧 𝔘",
    "x\0y", "�﻿", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "                                        x", "1234567890 12.50", "ﷺ ﷺﷺ", "‮abc",
]


@pytest.fixture(scope="module")
def codec():
    return pieces.Codec(pieces.read_model(PATH))


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def random_texts(seed, count):
    rng = random.Random(seed)
    alphabets = ["ab", "a ", "the quick brown fox ", "▁ \t", "éßøñ 日本語 абв 😀", "".join(map(chr, range(32, 127))), "0123456789.,-", "\x00\x7f\xa0　 x"]
    for _ in range(count):
        letters = rng.choice(alphabets) + (rng.choice(alphabets) if rng.random() < 0.5 else "")
        yield "".join(rng.choice(letters) for _ in range(rng.randrange(0, 120)))


def test_encodes_as_the_library(codec, library):
    for text in HARD + list(random_texts(1, 3000)):
        assert codec.encode(text) == library.encode(text), text
        assert codec.decode(codec.encode(text)) == library.decode(library.encode(text)), text


def test_decodes_any_ids_as_the_library(codec, library):
    rng = random.Random(2)
    for _ in range(3000):
        top = rng.choice([10, 300, 32000])
        ids = [rng.randrange(top) for _ in range(rng.randrange(0, 30))]
        assert codec.decode(ids) == library.decode(ids), ids


def test_chain_equals_merging(codec):
    for text in random_texts(3, 400):
        marked = text.replace(" ", pieces.SPACE)
        assert codec.split(marked) == codec.merged(marked)


@pytest.mark.parametrize("cut", [lambda text: [text], pieces.MARKED.findall])
def test_backtracking_without_words_apart(library, cut):
    codec = pieces.Codec(pieces.read_model(PATH))
    assert codec.cut("▁ab,²1▁▁") == ["▁ab,²1", "▁▁"] and codec.cut("▁ab,12▁▁") == ["▁ab", ",", "1", "2", "▁▁"]
    codec.cut = cut
    for text in HARD + list(random_texts(4, 500)):
        assert codec.encode(text) == library.encode(text), text


def test_small_model_that_needs_to_go_back():
    """Longest pieces first would take ``abc``; the merges make ``ab`` and ``cd``."""
    text = [("ab", -1.0), ("cd", -2.0), ("abc", -3.0), ("a", -9.0), ("b", -9.1), ("c", -9.2), ("d", -9.3), ("bc", -4.0), ("bcd", -5.0)]
    raw = [("<unk>", 0.0, pieces.UNKNOWN)] + [(f"<0x{b:02X}>", 0.0, pieces.BYTE) for b in range(256)] + [(p, s, pieces.NORMAL) for p, s in text]
    codec = pieces.Codec({"pieces": raw, "prefix": False, "unknown": "?"})
    assert codec.split("abcd") == ["ab", "cd"] and codec.split("abc") == ["abc"]
    rng = random.Random(5)
    for _ in range(2000):
        word = "".join(rng.choice("abcd") for _ in range(rng.randrange(1, 14)))
        assert codec.split(word) == codec.merged(word)


def test_memory_is_bounded_and_forgetting_is_harmless(monkeypatch, library):
    monkeypatch.setattr(pieces, "KEPT_WORDS", 5)
    monkeypatch.setattr(pieces, "KEPT_PAIRS", 7)
    codec = pieces.Codec(pieces.read_model(PATH))
    for text in random_texts(6, 200):
        assert codec.encode(text) == library.encode(text)
        assert max(len(codec.words), len(codec.older)) <= 5 and sum(map(len, codec.pairs.values())) <= 7


def test_documents(spark, docs, library):
    long = "word " * 40_000 + "²³½Ⅷ٣_a1_" * 10 + "x" * 50_000
    rows = [(1, None), (2, ""), (3, long), (None, "no id"), (4, "same"), (4, "same"), (5, "<|im_end|> 😀")]
    df = docs(rows, clashing=True).withColumn("ids", pieces.F.lit(7)).withColumn("decoded", pieces.F.lit("x"))
    out = pieces.decode_documents(pieces.encode_documents(df, PATH), PATH)
    assert set(out.columns) == set(df.columns)
    got = sorted(((r.doc_id, list(r.ids), r.decoded) for r in out.collect()), key=repr)
    want = sorted(((i, library.encode(t or ""), library.decode(library.encode(t or ""))) for i, t in rows), key=repr)
    assert got == want
    assert pieces.encode_documents(docs([(1, "a")]).where("doc_id > 1"), PATH).count() == 0


def test_null_ids_give_null(spark):
    df = spark.createDataFrame([(1, None), (2, []), (3, [22557])], "k int, ids array<int>").coalesce(1)
    assert [(r.k, r.decoded) for r in pieces.decode_documents(df, PATH).orderBy("k").collect()] == [(1, None), (2, ""), (3, "Hello")]


def test_other_models_are_refused(tmp_path):
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    model.ParseFromString(open(PATH, "rb").read())
    model.trainer_spec.model_type = 1
    (tmp_path / "m").write_bytes(model.SerializeToString())
    with pytest.raises(ValueError):
        pieces.read_model(str(tmp_path / "m"))


def test_given_documents(codec, library):
    for (text,) in duckdb.sql("SELECT text FROM '/root/testdata/sf0.001/documents.parquet'").fetchall():
        assert codec.encode(text) == library.encode(text or "")
