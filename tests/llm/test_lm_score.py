import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from wardlens.llm import lm_score

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def brute(rows):
    text = [WORD.findall((t or "").encode().translate(LOW)) for _, t, _ in rows]
    uni, bi = [Counter(), Counter()], [Counter(), Counter()]
    for w, (_, _, chosen) in zip(text, rows):
        for k in (0, 1) if chosen else (0,):
            uni[k].update(w)
            if w:
                uni[k][None] += 1
            bi[k].update(zip([None, *w], w))
    size = len([x for x in uni[0] if x is not None])
    total = [sum(n for x, n in c.items() if x is not None) for c in uni]
    out = []
    for w, (d, _, _) in zip(text, rows):
        loss = []
        for k in (1, 0):
            p = lambda b: (uni[k][b] + lm_score.ALPHA) / (total[k] + lm_score.ALPHA * size)  # noqa: E731,B023
            loss.append(sum(-math.log((bi[k][a, b] + lm_score.MU * p(b)) / (uni[k][a] + lm_score.MU)) for a, b in zip([None, *w], w)) / max(1, len(w)))
        out.append((d, len(w), *loss, loss[0] - loss[1]))
    return out


@pytest.mark.parametrize("batch", [1 << 24, 400])
@pytest.mark.parametrize("targets", [0, 3])
def test_equals_brute_force(spark, batch, targets):
    rng = random.Random(0)
    words = ["the", "The", "a", "of", "naïve", "word", "extraordinarily", "x1"]
    rows = [(i // 2 if i % 9 else None, " ".join(rng.choice(words) for _ in range(rng.randrange(40))), bool(targets) and i % targets == 0) for i in range(80)]
    rows += [(200, None, True), (201, "", False), (202, "!!", False), (203, "the " * 20000, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, flag boolean").withColumns({c: F.lit(1) for c in ("target", "batch", "kind", "keys")})
    got = sorted(map(tuple, lm_score.score(d, F.col("flag"), buckets=5, batch_bytes=batch).collect()), key=repr)
    want = sorted(brute(rows), key=repr)
    assert [(g[0], g[1]) for g in got] == [(w[0], w[1]) for w in want]
    by = lambda rows: sorted((str(r[0]), r[1], *(round(x, 9) + 0.0 for x in r[2:])) for r in rows)
    assert by(got) == by(want)


def test_counts_pack_without_loss():
    import numpy as np
    for c in ([], [0, 1, 254, 255, 256, 1 << 40], [3] * 1000):
        a = np.array(c, dtype=np.uint64)
        assert lm_score.unpack(lm_score.pack(a), len(a)).tolist() == c


def test_empty_table(documents):
    assert lm_score.score(documents([]), F.lit(True)).count() == 0


def test_inputs_that_read_differently_every_time(spark):
    """A shuffled input, and whole batches that repeat: both passes see the same batches."""
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice(["a", "b", "c", "dd"]) for _ in range(12)), i % 2 == 0) for i in range(60)] + [(100, "same text here again", True)] * 40
    d = spark.createDataFrame(rows, "doc_id long, text string, flag boolean").orderBy(F.rand())
    got = lm_score.score(d, F.col("flag"), batch_bytes=60).collect()
    by = lambda rows: sorted((str(r[0]), r[1], *(round(x, 9) + 0.0 for x in r[2:])) for r in rows)
    assert by(map(tuple, got)) == by(brute(rows))


def test_equal_batches_are_scored_one_by_one(spark, monkeypatch):
    """Batches of the same texts in the same order, ids and all, do not meet in one group."""
    one = [(i, f"some words of text {i}", i == 0) for i in range(3)]
    rows = [*one * 20, (9, "other words", None)]
    make = lm_score._score

    def alone(*a):
        run = make(*a)

        def checked(texts, totals):
            assert texts.num_rows <= 1
            return run(texts, totals)
        return checked
    monkeypatch.setattr(lm_score, "_score", alone)
    d = spark.createDataFrame(rows, "doc_id long, text string, flag boolean").repartition(1)
    got = lm_score.score(d, F.col("flag"), batch_bytes=60).collect()
    by = lambda rows: sorted((str(r[0]), r[1], *(round(x, 9) + 0.0 for x in r[2:])) for r in rows)
    assert by(map(tuple, got)) == by(brute(rows))
