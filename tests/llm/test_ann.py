import math

import numpy as np
import pytest

from wardlens.llm import ann


def brute(rows, queries, k):
    def ok(v):
        return bool(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)
    usable = [(i, v) for i, v in rows if i is not None and ok(v)]
    out = []
    for q, v in queries:
        if q is None or not ok(v):
            continue
        best = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in usable if i != q)[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return sorted(out)


def table(n=300, seed=0):
    rng = np.random.default_rng(seed)
    rows = [(i, rng.integers(-8, 9, 6).astype(float).tolist()) for i in range(n)]
    rows += [(1000 + i, rows[20][1]) for i in range(60)]                      # one large group of copies
    rows += [(2000, None), (2020, [0.0] * 6), (2040, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (2060, [math.nan] * 6), (2080, [math.inf] + [1.0] * 5),
             (None, rows[3][1]), (40, rows[40][1]), (2100, [])]
    return rows


@pytest.mark.parametrize("shard_rows,block_rows,sample", [(10_000, 10_000, 4096), (60, 7, 4096), (20, 7, 8)])
def test_factor_one_is_exact(spark, shard_rows, block_rows, sample):
    rows = table()
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS rank", "'x' AS v", "2 AS shard")
    q = d.filter("vec_id % 20 = 0")
    got = ann.nearest(d, q, k=20, relax=1.0, shard_rows=shard_rows, block_rows=block_rows, task_queries=5, sample=sample)
    distinct = {i: v for i, v in rows if i is not None and i % 20 == 0}
    # an id that repeats asks once per row; its rows collapse in the ranking, so compare the others
    want = [r for r in brute(rows, [(i, v) for i, v in distinct.items() if i != 40], 20)]
    assert sorted(tuple(r) for r in got.collect() if r.query_id != 40) == want


def test_few_candidates_and_empty_tables(spark):
    d = spark.createDataFrame([(0, [1.0, 0.0]), (20, [1.0, 0.0]), (3, [0.5, 0.5])], "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in ann.nearest(d, d.filter("vec_id % 20 = 0")).collect())
    assert got == [(0, 1, 20, 1.0), (0, 2, 3, 0.5), (20, 1, 0, 1.0), (20, 2, 3, 0.5)]
    none = d.filter("false")
    assert ann.nearest(none, none).count() == 0
    assert ann.nearest(d, none).count() == 0


def test_recall_of_the_production_factor(spark):
    from wardlens.llm.queries import op5_ann
    sf = "/root/testdata/sf0.1"
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").toPandas()
    v, ids = np.stack(rows.embedding).astype(float), rows.vec_id.to_numpy()
    got = op5_ann(spark, sf).toPandas().groupby("query_id").vec_id.apply(set)
    recall = []
    for q in np.flatnonzero(ids % 20 == 0):
        s = v @ v[q]
        s[q] = -np.inf
        recall.append(len(got[ids[q]] & set(ids[np.argsort(-s)[:20]])) / 20)
    assert np.mean(recall) >= 0.9


def test_repeated_query_ids_lose_nothing(spark):
    """Equal rows of an id share one full result; its other vectors have their own."""
    rows = table()
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = ann.nearest(d, d.filter("vec_id = 40"), k=20, relax=1.0)
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, [(40, rows[40][1])], 20)
    other = spark.createDataFrame([(40, rows[40][1]), (40, rows[7][1])], d.schema)
    got = ann.nearest(d, other, k=20, relax=1.0)
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, [(40, rows[40][1]), (40, rows[7][1])], 20)


def test_repeated_ids_leave_room_for_other_copies(spark):
    """A query discards all rows of its own id; the other copies of the vector are still there."""
    rows = [(0, [1.0, 2.0])] * 9 + [(i, [1.0, 2.0]) for i in range(1, 4)] + [(9, [0.5, 0.5])] * 5
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = ann.nearest(d, d.filter("vec_id = 0"), k=5, relax=1.0)
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, rows[:1], 5)


def frame(spark, v, first=0):
    return spark.createDataFrame([(first + i, x) for i, x in enumerate(v.tolist())], "vec_id long, embedding array<double>")


def best_ids(v, q, k):
    """Ids of the k nearest by exact component-wise sums, ties to the smaller id."""
    s = ann.exact_scores(np.repeat(v[q:q + 1], len(v), axis=0), v)
    s[q] = -np.inf
    return np.lexsort((np.arange(len(v)), -s))[:k].tolist()


def got_ids(out):
    found = {}
    for r in sorted(out.collect(), key=lambda r: (r.query_id, r["rank"])):
        found.setdefault(r.query_id, []).append(r.vec_id)
    return found


def test_ties_beyond_the_asked_number_go_to_the_smaller_ids(spark):
    """A hundred candidates of equal score; and signs in 16 dimensions, where scores tie all over."""
    v = np.array([[1.0] + [0.0] * 8] + [[1.0, *np.eye(8)[i % 8] * (i + 1)] for i in range(100)])
    for relax in (1.0, 1.2):
        assert got_ids(ann.nearest(frame(spark, v), frame(spark, v[:1]), 20, relax, shard_rows=30)) == {0: list(range(1, 21))}
    v = np.random.default_rng(1).choice([-1.0, 1.0], (3000, 16))
    d = frame(spark, v)
    got = got_ids(ann.nearest(d, d.filter("vec_id % 20 = 0"), 20, 1.0, shard_rows=400))
    assert got == {q: best_ids(v, q, 20) for q in range(0, 3000, 20)}


@pytest.mark.parametrize("long", [1e6, 1e9, 1e200])
def test_one_very_long_vector_spoils_no_others(spark, long):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(1000, 12))
    v[17] *= long
    d = frame(spark, v)
    got = got_ids(ann.nearest(d, d.filter("vec_id % 20 = 0"), 20, 1.0, shard_rows=150))
    assert got == {q: best_ids(v, q, 20) for q in range(0, 1000, 20)}


def test_lengths_of_many_sizes_and_shorter_vectors(spark):
    rng = np.random.default_rng(3)
    rows = [(i, (rng.normal(size=rng.integers(1, 7)) * 10.0 ** rng.integers(-3, 4)).tolist()) for i in range(400)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = got_ids(ann.nearest(d, d.filter("vec_id % 20 = 0"), 10, 1.0, shard_rows=40))
    v = np.array([x + [0.0] * (6 - len(x)) for _, x in rows])
    assert got == {q: best_ids(v, q, 10) for q in range(0, 400, 20)}
    wide = spark.createDataFrame([(1000, [1.0] * 9)], d.schema)  # longer than any candidate
    assert got_ids(ann.nearest(d, wide, 5, 1.0)) == {1000: np.lexsort((np.arange(400), -(v.sum(1)))).tolist()[:5]}


def test_regions_and_shards_are_pruned_where_vectors_cluster(spark):
    """Far clusters are never sent a query: rows that travel grow with the queries, not with queries x shards."""
    rng = np.random.default_rng(4)
    centers = rng.normal(size=(16, 24)) / np.sqrt(24)
    v = np.concatenate([c + rng.normal(size=(100, 24)) * 0.01 for c in centers])
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    index = ann.build_index(ann.usable(frame(spark, v)), 20, shard_rows=100)
    home = index.top.place(v)
    worst = np.array([np.sort(v[home == home[q]] @ v[q])[-21:][0] for q in range(len(v))])
    q, _ = index.top.others(v, worst, home, 1.0)
    assert index.top.regions >= 16 and len(q) < 4 * len(v)
