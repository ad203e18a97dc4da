import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from wardlens.llm import simhash


def brute_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    h = [xxhash.xxh64_intdigest(b" ".join(words[i:i + 3]), 42) for i in range(max(1, len(words) - 2))] if words else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(rows, bits=3):
    fp = [brute_fingerprint(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i
    for i in range(len(rows)):
        for j in range(i):
            if (fp[i] ^ fp[j]).bit_count() <= bits:
                parent[root(i)] = root(j)
    best = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            best[root(i)] = min(best.get(root(i), d), d)
    return sorted(((d, f"{f:016x}", best.get(root(i))) for i, ((d, _), f) in enumerate(zip(rows, fp))), key=repr)


def sample(seed=3):
    rng = random.Random(seed)
    word = [f"w{i}" for i in range(400)]
    base = [[rng.choice(word) for _ in range(rng.choice([1, 2, 3, 30, 200]))] for _ in range(25)]
    rows = []
    for w in base:
        for _ in range(4):
            w = list(w)
            w[rng.randrange(len(w))] = rng.choice(word)
            rows.append(" ".join(w))
    rows += ["", None, " \t\n", "One", "one", "a\x0bb\x0cc d", "a b c D", "x " * 30000, "É è", "é è"]
    return [(None if i % 19 == 0 else i // 2, t) for i, t in enumerate(rows)]


def test_equals_brute_force(documents):
    rows = sample()
    got = simhash.near_duplicates(documents(rows))
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(rows)


@pytest.mark.parametrize("hot,crowded", [(4, 8192), (4, 16)])
def test_hot_variants_are_cut_without_loss(spark, hot, crowded):
    """Many distinct fingerprints under one variant: cut by bytes or by half-bytes, the same components."""
    rng = np.random.default_rng(0)
    low = np.uint64(0x12345678)
    fp = np.unique((rng.integers(0, 1 << 32, 600, dtype=np.uint64) << np.uint64(32)) | low)
    near = fp[:200] ^ (np.uint64(1) << rng.integers(32, 64, 200).astype(np.uint64)) ^ np.uint64(1)
    fp = np.unique(np.concatenate((fp, near)))
    d = spark.createDataFrame([(int(x),) for x in fp.view(np.int64)], "fp long")
    found = {frozenset(r) for r in simhash.links(d, hot=hot, crowded=crowded).collect()}
    want = {frozenset((int(np.int64(a.view(np.int64))), int(np.int64(b.view(np.int64)))))
            for i, a in enumerate(fp) for b in fp[:i] if int(a ^ b).bit_count() <= 3}

    def classes(pairs):
        parent = {}

        def root(x):
            while parent.setdefault(x, x) != x:
                x = parent[x]
            return x
        for p in pairs:
            a, b = tuple(p)
            parent[root(a)] = root(b)
        return {frozenset(y for y in parent if root(y) == r) for r in map(root, list(parent))}
    assert found <= want and classes(found) == classes(want)


def test_keep_one_row_of_each_group(documents):
    rows = [(1, "a b c d e f"), (2, "A b c d e f"), (2, "A b c d e f"), (3, "other words here now"), (None, "p q r s"),
            (None, "p q r s"), (None, "p q r s t u v w x")]
    out = simhash.keep_one(documents(rows))
    assert out.columns == documents(rows).columns
    kept = sorted(((r.doc_id, r.text) for r in out.collect()), key=repr)
    want = brute(rows)
    assert (1, "a b c d e f") in kept and (3, "other words here now") in kept
    assert len(kept) == len({c if c is not None else f for _, f, c in want})


def test_empty_table_and_wrong_bits(documents):
    assert simhash.near_duplicates(documents([])).count() == 0
    assert simhash.keep_one(documents([])).count() == 0
    with pytest.raises(ValueError):
        simhash.links(documents([]), max_bits=4)


def test_keep_one_goes_by_component_not_by_id(documents):
    """One id on two unlinked texts keeps a row of each component; linked copies without ids keep one row."""
    rng = random.Random(5)
    a, b, c = (" ".join(rng.choice("abcdefgh") * 3 + str(rng.randrange(99)) for _ in range(60)) for _ in range(3))
    assert all((brute_fingerprint(x) ^ brute_fingerprint(y)).bit_count() > 3 for x, y in ((a, b), (a, c), (b, c)))
    got = simhash.keep_one(documents([(5, a), (7, a), (5, b), (9, b)])).collect()
    assert sorted((r.doc_id, r.text) for r in got) == sorted([(5, a), (5, b)])
    long = [rng.choice("abcdefgh") * 3 + str(rng.randrange(99)) for _ in range(3000)]
    near = next(x for x in (" ".join([*long[:i], "zz", *long[i + 1:]]) for i in range(3000))
                if 0 < (brute_fingerprint(x) ^ brute_fingerprint(" ".join(long))).bit_count() <= 3)
    got = simhash.keep_one(documents([(None, " ".join(long)), (None, near), (None, c)])).collect()
    assert len(got) == 2 and c in [r.text for r in got]


def test_names_of_other_columns_do_not_matter(spark, documents):
    d = documents([(1, "a b c d"), (2, "a b c d"), (3, "other words here")]).withColumnsRenamed({"fingerprint": "_n", "ids": "_text_key", "rank": "_id", "piece": "_key"})
    out = simhash.keep_one(d)
    assert out.columns == d.columns and sorted((r.doc_id, r["_n"], r["_text_key"]) for r in out.collect()) == [(1, 7, 7), (3, 7, 7)]


def test_fingerprints_are_dealt_out_before_they_become_variants(spark):
    fps = spark.range(1000).selectExpr("xxhash64(id) AS fp").groupBy("fp").count().select("fp")
    plan = simhash.links(fps)._jdf.queryExecution().executedPlan().toString()
    dealt = [line for line in plan.splitlines() if "REPARTITION_BY_NUM" in line and "xxhash64(fp" in line]
    assert len(dealt) == 2  # in both branches, and adaptive execution leaves such exchanges as they are


def test_half_bytes_bound_a_bucket_and_meet_every_link():
    masks = simhash.HALF_BYTES
    assert len(masks) == 56 and {m.bit_count() for m in masks} == {20}
    rng = random.Random(5)
    for _ in range(2000):
        differ = sum(1 << b for b in rng.sample(range(32), rng.randint(0, 3)))
        assert any(not differ & m for m in masks)


def test_no_join_of_the_variants_is_broadcast(spark):
    """Every fingerprint has 64 variants, but Spark sizes them like the fingerprints: below its threshold, one side would go through the driver."""
    fps = simhash.materialize(spark.range(500).select(F.xxhash64("id").alias("fp")), "few")
    found = simhash.links(fps)
    assert found.collect() == []
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
