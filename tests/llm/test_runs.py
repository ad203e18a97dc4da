"""Periodic runs against a search over every stretch, and the registered digests against plain Python."""
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from wardlens.llm import queries, runs

SF = "/root/testdata/sf0.001"


def brute(words, least=12):
    """(start, length, period) of all runs: every lag, every maximal stretch of equal words, smallest period of the stretch."""
    n, found = len(words), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(least, 2 * q):
                part = words[i:i + length]
                if not any(all(part[k] == part[k + p] for k in range(length - p)) for p in range(1, q)):
                    found.append((i, length, q))
            i = j + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def kept(words, found):
    gone = {k for s, length, q in found for k in range(s + q, s + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def by_find(texts, least=12):
    code = {w: i for i, w in enumerate(sorted({w for t in texts for w in t}))}
    first = np.cumsum([0] + [len(t) for t in texts])
    got = runs.find(np.array([code[w] for t in texts for w in t], dtype=np.int64), first, least) if first[-1] else np.zeros((0, 3), int)
    owner = np.searchsorted(first, got[:, 0], "right") - 1
    return [[(int(s - first[i]), int(e - s), int(q)) for (s, e, q), o in zip(got, owner) if o == i] for i in range(len(texts))]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=60), max_size=6), st.sampled_from([4, 5, 12]))
def test_small_alphabets(texts, least):
    assert by_find(texts, least) == [brute(t, least) for t in texts]


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**9))
def test_planted_periods(seed):
    r, texts = random.Random(seed), []
    for _ in range(5):
        t = []
        for _ in range(r.randint(0, 6)):
            period = [r.randint(0, 30) for _ in range(r.randint(1, 25))]
            t += (period * r.randint(1, 5))[:r.randint(1, 90)] + [r.randint(0, 400) for _ in range(r.randint(0, 8))]
        texts.append(t)
    assert by_find(texts) == [brute(t) for t in texts]


def test_one_long_text_of_one_word(monkeypatch):
    monkeypatch.setattr(runs, "PROBES", 1000)  # portions smaller than one lag's probes
    assert by_find([[0] * 5000, [0, 1] * 1500 + [2]]) == [[(0, 5000, 1)], [(0, 3000, 2)]]


def test_misled_hash_is_found_and_mended(monkeypatch):
    real, bases = runs._scan, []

    def weak(kind, begin, end, least, base):
        bases.append(base)
        return real(kind, begin, end, least, 0 if len(bases) == 1 else base)  # base 0: all later words hash alike
    monkeypatch.setattr(runs, "_scan", weak)
    text = [1, 2, 3, 4] * 6 + [5, 6, 7, 5, 6, 7] + [1, 2, 3, 4] * 3
    assert by_find([text]) == [brute(text)]
    assert len(bases) > 1


def test_split_keeps_words_of_runs_only():
    kind = np.array([0] * 14 + [9] + [1, 2] * 3 + [8] + [3, 4, 5, 6, 7, 10, 11] * 2)
    begin, end = runs.split(kind, np.array([0, len(kind)]))
    assert sorted(zip(begin.tolist(), end.tolist())) == [(0, 14), (22, 36)]


def expected(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    if doc_id is not None:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[a + (i - a) % p] if i >= a else words[i] for i in range(n)]
    found = brute(words)
    top = max(found, key=lambda r: (r[1], -r[0], -r[2])) if found else (None,) * 3
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc_id, len(found), *top, 1000 * top[1] // top[2] if found else None,
            sha("".join(f"{s},{n},{q}\n" for s, n, q in found)), sha(kept(words, found)), n)


COLS = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256", "n_words")
key = lambda r: str(r)


def test_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = queries.op13_runs(spark, SF).select(*COLS).collect()
    assert sorted(map(tuple, got), key=key) == sorted((expected(*d) for d in docs), key=key)


def test_edge_cases(spark, documents):
    planted = [i for i in range(200) if zlib.crc32(str(i).encode()) % 10 == 0][:6]
    rows = [(1, None), (2, ""), (3, " \t\n\x0b\x0c\r "), (None, "a b " * 20), (None, None), (5, "x " * 40000), (5, "x " * 40000),
            (7, "é b 　 é b 　 " * 4), (8, "a" * 100_000 + " b"), (9, "tail  " + "one two three\n" * 6 + "end")]
    rows += [(planted[0], None), (planted[1], ""), (planted[2], "solo"), (planted[3], " ".join(f"w{i}" for i in range(300))),
             (planted[4], " ".join("abcdefg"[i % 7] for i in range(90))), (planted[5], "p q " * 9)]
    sha = lambda b: hashlib.sha256(b).hexdigest()
    one_word = (5, 1, 0, 40000, 1, 40_000_000, sha(b"0,40000,1\n"), sha(b"x"), 40000)
    assert zlib.crc32(b"5") % 10
    want = [one_word if r[0] == 5 else expected(*r) for r in rows]
    out = runs.digests(runs.collapse_runs(runs.plant(documents(rows)))).select(*COLS).collect()
    assert sorted(map(tuple, out), key=key) == sorted(want, key=key)


@pytest.mark.parametrize("rows", [[], [(1, "a b " * 10)]])
def test_extra_columns(spark, documents, rows):
    docs = documents(rows).withColumnRenamed("n_chars", "given").withColumnRenamed("lang", "N_words")
    out = runs.collapse_runs(runs.plant(docs))
    assert out.columns == [c for c in docs.columns if c not in ("runs", "N_words")] + ["n_words", "runs", "collapsed"]
    got = out.collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r["collapsed"], [tuple(x) for x in r["runs"]], r["fingerprint"], r["given"]) == ("a b", [(0, 20, 2)], 7, None)
