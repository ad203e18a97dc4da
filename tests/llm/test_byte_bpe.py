"""The serialised model against the tiktoken library, piece by piece and text by text."""
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tiktoken

from wardlens.llm import byte_bpe, queries

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def coder():
    return byte_bpe.Coder.load(PATH, public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def library(coder):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: i for i, t in enumerate(coder.tokens)}, special_tokens={})


def ids_of(coder, texts):
    ids, size = byte_bpe.Memory(coder).encode_texts(iter(texts))
    return [x.tolist() for x in np.split(ids, np.cumsum(size)[:-1])]


def test_model_is_the_vocabulary(coder):
    sp = sentencepiece.SentencePieceProcessor(model_proto=coder.model)
    assert sp.get_piece_size() == len(coder.tokens) + 1 and sp.unk_id() == len(coder.tokens)
    assert [sp.get_score(i) for i in (0, 1, 50_000)] == [0.0, -1.0, -50_000.0]
    assert coder.bytes_of == coder.tokens


ODD = ["", " ", "  \n\t\x1c\x85   x  ", "don't 'LL 's'T", "１２３ ½ Ⅷ ²", "é é ß İ ſ", "日本語のテキスト、テスト。", "👩‍👩‍👧 \U0001fae8", "͸ \U000323b0x \U0001e5d0",
       "▁ _  ￿ \x00 \x7f", "<|endoftext|><s></s><unk>", "a" * 3000, " " * 3000 + "b", "1" * 999, "\r\n\r\n", "क्षि ก็ Ελλ"]


def test_equals_the_library(coder, library):
    r = random.Random(7)
    every = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = ODD + ["".join(map(chr, r.sample(every, 60))) for _ in range(300)] + ["".join(r.choices("ab'stve 12.\né中١꟱", k=80)) for _ in range(300)]
    texts += ["".join(chr(c) + r.choice(" a1.") for c in coder.other)]  # every character that the tables class apart
    assert len(coder.other) > 0
    assert ids_of(coder, texts) == [library.encode_ordinary(t) for t in texts]


def test_small_portions_and_a_small_memory(coder, library, monkeypatch):
    monkeypatch.setattr(byte_bpe, "AT_ONCE", 5)
    monkeypatch.setattr(byte_bpe, "CACHED", 8)
    monkeypatch.setattr(byte_bpe, "CACHED_CHARS", 6)
    texts = ODD + ["", "one two three four five six seven extraordinarily"] * 2
    assert ids_of(coder, texts) == [library.encode_ordinary(t) for t in texts]


def test_missing_ranks_and_ties_to_the_left():
    """Ids without a token stay unused; equal pairs merge leftmost first; a token that merges never reach is still itself."""
    tokens = [bytes([b]) for b in range(256)] + [b"aa", None, b"ab", b"xyz"]
    c = byte_bpe.Coder(tokens, byte_bpe.serialise(tokens), r"\S+|\s+", {})
    lib = tiktoken.Encoding("own", pat_str=r"\S+|\s+", mergeable_ranks={t: i for i, t in enumerate(tokens) if t}, special_tokens={})
    texts = ["aaaaa", "aab", "xyz", "xyzx", "baab aaa"]
    assert ids_of(c, texts) == [lib.encode_ordinary(t) for t in texts]
    assert c.decode(np.array([256, 258, 259])) == b"aaabxyz"


def row(library, doc_id, text):
    ids = library.encode_ordinary(text or "")
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return (doc_id, len(ids), sha(",".join(map(str, ids)).encode()), sha((text or "").encode()))


def test_query_equals_the_library(spark, library):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert sorted(map(tuple, queries.op11_byte_bpe(spark, SF).collect())) == sorted(row(library, *d) for d in docs)


def test_edge_cases(spark, documents, coder, library):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(None, None), (None, "x"), (3, None), (5, "twice"), (5, "twice"), (6, "long été " * 60_000)]
    got = byte_bpe.digests(documents(rows), coder).collect()
    key = lambda r: str(r)
    assert sorted(map(tuple, got), key=key) == sorted((row(library, *r) for r in rows), key=key)
    assert byte_bpe.digests(documents([]), coder).collect() == []


def test_other_columns_stay(spark, documents, coder):
    docs = documents([(1, "été one"), (2, None)]).withColumnRenamed("lang", "Ids2").withColumnRenamed("source", "cut")
    out = byte_bpe.decode(byte_bpe.encode(docs, coder), coder)
    assert out.columns == [c for c in docs.columns if c != "ids"] + ["ids", "decoded"]
    assert [(r["text"], bytes(r["decoded"]), r["score"], r["cut"]) for r in out.orderBy("doc_id").collect()] == [
        ("été one", "été one".encode(), 7, None), (None, b"", 7, None)]
