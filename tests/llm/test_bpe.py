import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from wardlens.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


def odd_texts():
    rng = random.Random(1)
    letters = "ab'slrevmdtS’éÉÀ ×1 9\n!<|.ßÞÿ"
    return ["", None, "I'll we've don't 's ''s !'s 'sam 'really 've 'LL it's’s", "ÀÉÑ ß × ÷ Straße naïvé é", "ΑΣ Σ İstanbul",
            "日本語 テスト 123 ４５ ²½", "<|endoftext|>hi<|startoftext|> <| x|", "a" * 300 + " " + "ab" * 100 + "é" * 70,
            "\x00 \x1c\x1f\x85\xa0 x y", "𐥀𐥁a 🙂🙂", "it''s o'clock 'D 'RE 'r 'v 'l 12 3a4'5s", "'", "ᲉaꟋb ౜x", "word " * 30000,
            *("".join(rng.choice(letters) for _ in range(40)) for _ in range(800))]


@pytest.mark.parametrize("lexicon", [0, 50, 5000])
def test_equals_the_library(documents, library, lexicon):
    texts = odd_texts()
    rows = [(None if i % 11 == 0 else i // 2, t) for i, t in enumerate(texts)]
    got = bpe.digests(documents(rows), PATH, lexicon).collect()
    want = []
    for (d, t), e in zip(rows, library.encode_batch([t or "" for t in texts], add_special_tokens=False)):
        ids = np.array(e.ids, "<u4").tobytes()
        text = library.decode(e.ids, skip_special_tokens=False)
        want.append((d, len(e.ids), hashlib.sha256(ids).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_automaton_is_minimal_and_exact(tmp_path):
    words = [b"stop", b"stops", b"top", b"tops", b"", b"a", b"\xc3\xa9s", b"s"]
    a = bpe.Automaton.compile({w: np.array([i, i + 100], np.int32) for i, w in enumerate(words) if w})
    f = tmp_path / "lexicon"
    f.write_bytes(a.to_bytes())
    m = bpe.Automaton.mapped(str(f))
    asked = [w for w in words if w] + [b"sto", b"stopsx", b"b", b"\xc3\xa9"]
    size = np.array([len(w) for w in asked])
    place = m.find(np.frombuffer(b"".join(asked), np.uint8), np.cumsum(size) - size, size)
    stored = sorted(w for w in words if w)
    assert [stored[p] if p >= 0 else None for p in place] == [w if w in stored else None for w in asked]
    for w, p in zip(asked, place):
        if p >= 0:
            assert m.ids[m.cut[p]:m.cut[p + 1]].tolist() == [words.index(w), words.index(w) + 100]
    suffixes = {frozenset(w[len(p):] for w in stored if w.startswith(p)) for w in stored for p in (w[:k] for k in range(len(w) + 1))}
    assert len(m.final) == len(suffixes)  # one state per distinct set of continuations


def test_long_words_merge_like_short_ones():
    v = bpe.Vocabulary.load(PATH)
    rng = random.Random(2)
    words = [bytes(rng.choice(b"abcdeths") for _ in range(rng.randrange(1, 48))) for _ in range(200)]
    for w, ids in zip(words, v.encode_words(words)):
        assert ids.tolist() == v.encode_long(w).tolist()


def test_round_trip_and_empty_table(documents):
    tokens, v = bpe.encode(documents([(1, "Hello world"), (2, None)]), PATH, 10)
    out = {r.doc_id: r for r in bpe.decode(tokens, v).collect()}
    assert out[1].decoded.replace(" ", "").replace("</w>", " ").strip() == "hello world" and out[2].decoded == ""
    assert bpe.digests(documents([]), PATH).count() == 0
