import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from wardlens.llm import suffix_dedup as sd


def brute(texts, length):
    many = Counter(t[i:i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t) + 1, bool)
        for i in range(len(t) - length + 1):
            if many[t[i:i + length]] > 1:
                gone[i:i + length] = True
        kept = bytes(b for b, g in zip(t, gone) if not g)
        runs = int((gone[:-1] & ~np.concatenate(([False], gone[:-2]))).sum()) if len(t) else 0
        out.append((len(t), int(gone[:-1].sum()), runs, hashlib.sha256(kept).hexdigest()))
    return out


def sample(seed):
    rng = random.Random(seed)
    texts = ["", None, "x" * 500, "x" * 350, "ab" * 300, "é" * 150, "y" * 199, "z" * 200]
    base = ["".join(rng.choice("abcdé \n") for _ in range(rng.randint(100, 1500))) for _ in range(25)]
    texts += base + base[:3]
    for _ in range(60):
        a, b, c = (rng.choice(base) for _ in range(3))
        i, j = rng.randrange(len(a)), rng.randrange(len(b))
        texts.append(a[i:i + rng.randrange(600)] + rng.choice("xyz") + b[j:j + rng.randrange(600)] + c[:rng.randrange(300)])
    return [(None if i % 17 == 0 else i // 2, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("hot", [sd.HOT_SPANS, 1])
def test_equals_brute_force(documents, monkeypatch, hot):
    monkeypatch.setattr(sd.repeated_runs, "__defaults__", (sd.LENGTH, sd.ANCHOR, hot))
    rows = sample(1)
    got = sd.report(documents(rows)).collect()
    assert sorted(tuple(r)[1:] for r in got) == sorted(brute([(t or "").encode() for _, t in rows], 200))


def test_long_texts_in_parts(documents, monkeypatch):
    monkeypatch.setattr(sd, "PART", 300)
    rows = sample(2)
    parts = sd.text_anchors(np.frombuffer(rows[10][1].encode(), np.uint8), 200, 100)
    assert parts[1].sum() == len(rows[10][1].encode()) - 199  # every string is in one run
    assert sd.report(documents(rows)).count() == len(rows)


def test_multikey_quicksort_finds_equal_strings():
    rng = np.random.default_rng(0)
    data = np.concatenate((rng.integers(0, 2, 3000).astype(np.uint8), np.zeros(8, np.uint8)))
    start = np.arange(2900)
    for length in (7, 8, 20):
        got = sd.multikey_repeats(data, start, np.zeros(2900, np.int64), length)
        seen = Counter(data[i:i + length].tobytes() for i in start)
        assert got.tolist() == [seen[data[i:i + length].tobytes()] > 1 for i in start]


def test_texts_stay_valid(documents):
    shared = "é" * 150 + "0123456789" * 20
    d = documents([(1, "à" + shared + "ü"), (2, "ê" + shared + "ö"), (3, None), (4, "short")]).withColumn("n_chars", F.lit(9).cast("long"))
    out = {r.doc_id: r for r in sd.remove_repeats(d).collect()}
    assert out[1].text == "àü" and out[2].text == "êö" and out[1].n_chars == 2
    assert out[3].text is None and out[4].text == "short"
    assert sd.remove_repeats(d).columns == d.columns


def test_empty_table(documents):
    assert sd.report(documents([])).count() == 0


def test_names_of_other_columns_do_not_matter(spark, documents):
    same = "".join(f"{i:04d}" for i in range(100))
    renamed = dict(zip(("fingerprint", "component_id", "score", "ids", "piece", "rank", "runs"), ("_k", "_r", "_key", "_row", "_runs", "reps", "_reps")))
    d = documents([(1, same + "x"), (2, "y" + same), (3, "alone")]).withColumnsRenamed(renamed)
    out = sd.remove_repeats(d, 200)
    assert out.columns == d.columns
    assert sorted((r.doc_id, r.text, *(r[c] for c in renamed.values())) for r in out.collect()) == [(i, t, *[7] * 7) for i, t in ((1, "x"), (2, "y"), (3, "alone"))]


def test_a_passage_of_many_documents_is_dealt_to_many_buckets(spark, documents, monkeypatch):
    """The spans at its two ends differ in every document; equal suffixes fill several buckets and meet across their boundaries."""
    rng = random.Random(4)
    own = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    passage = own(330)
    rows = [(i, own(rng.randint(60, 260)) + passage + own(rng.randint(60, 260))) for i in range(160)]
    real = sd._buckets
    monkeypatch.setattr(sd.repeated_runs, "__defaults__", (sd.LENGTH, sd.ANCHOR, 5))
    got = sd.report(documents(rows)).collect()
    assert sorted(tuple(r)[1:] for r in got) == sorted(brute([t.encode() for _, t in rows], 200))
    suffix = own(200).encode()
    shipped = [(suffix, 7, i, i % 50, -1, b"") for i in range(90)] + [(own(200).encode(), 8, 1000 + i, 0, -1, b"") for i in range(30)]
    for parts in (1, 2, 5, 90):  # whatever the boundaries, the same suffixes are found
        order = sorted(shipped)
        found = set()
        edges = {}
        for k in range(parts):
            part = order[len(order) * k // parts:len(order) * (k + 1) // parts]
            if not part:
                continue
            for b in real(200)(iter([pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*part)], ["lead", "piece", "span", "first", "place", "body"])])):
                for piece, span, s, e, edge in zip(*(c.to_pylist() for c in b.columns)):
                    if edge is None:
                        found.add((piece, span, s))
                    else:
                        edges.setdefault(edge, set()).add((piece, span, s))
        found |= {x for rows in edges.values() if len(rows) > 1 for x in rows}
        assert found == {(7, i, i % 50) for i in range(90)}
