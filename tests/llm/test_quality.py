import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from wardlens.llm import quality


def corpus(n=400):
    rng = random.Random(0)
    good, bad = ["river", "stone", "walk", "light"], ["$$$", "!!", "BUY", "|"]
    rows, labels = [], []
    for i in range(n):
        y = int(rng.random() < 0.8)
        rows.append((i, " ".join(rng.choice((good if y else bad) + ["the", "of"]) for _ in range(rng.randrange(5, 40)))))
        labels.append((i, y, 0))
    return rows, labels


def test_held_out_accuracy_and_edges(spark, documents):
    rows, labels = corpus()
    rows += [(1000, None), (1001, ""), (None, "river stone"), (5, rows[5][1]), (1002, "walk " * 50000)]
    labels += [(None, 1, 0), (7, None, 0), (8, 5, 0), (9, labels[9][1], 1)]
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    out = quality.classify(documents(rows), lab).toPandas()
    assert len(out) == len(rows) and out.score.between(0, 1).all()
    y = {i: v for i, v, _ in labels[:400]}
    held = out[out.held_out & out.doc_id.isin(list(y))]
    assert len(held) > 50 and (held.predicted == held.doc_id.map(y)).mean() > 0.95
    assert ((out.score >= 0.7).astype(int) == out.predicted).all()
    assert out[out.doc_id == 1000].score.iloc[0] == out[out.doc_id == 1001].score.iloc[0]
    assert not out[out.doc_id.isna()].held_out.any()


def test_labels_of_the_held_out_fold_are_not_learnt(spark, documents):
    rows, labels = corpus(200)
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    flipped = lab.withColumn("quality", F.when(quality.fold(F.col("doc_id")) == 2, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (quality.classify(documents(rows), x).orderBy("doc_id").toPandas().score for x in (lab, flipped))
    assert np.allclose(a, b)


@pytest.mark.parametrize("labels", [[], [(1, 1, 0), (2, 1, 0)]])
def test_one_class_or_none_gives_a_constant(spark, documents, labels):
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    out = quality.classify(documents([(1, "a"), (2, "b c"), (3, None)]), lab).toPandas()
    assert out.score.nunique() == 1 and len(out) == 3
    assert quality.keep_good(documents([]), lab).count() == 0


def test_indicators_by_brute_force():
    data = "A a\tA !! a".encode() + "b".encode()
    doc, slot = quality.features(np.frombuffer(data, np.uint8), np.array([0, 10, 11]))
    assert (doc == 0).sum() == len({"A", "a", "!!"}) + len({("A", "a"), ("a", "A"), ("A", "!!"), ("!!", "a")})
    assert (doc == 1).sum() == 1


def test_coordinate_descent_separates():
    rng = np.random.default_rng(1)
    slots = [np.array([0, 2 + rng.integers(5)]) if i % 2 else np.array([1, 2 + rng.integers(5)]) for i in range(60)]
    y = np.array([1 if i % 2 else -1 for i in range(60)])
    w, b = quality.coordinate_descent(slots, y, np.ones(8))
    assert (np.sign(quality.margins(slots, np.ones(8), w, b)) == y).all()


def test_repeated_labelled_ids_stay_within_the_sample(spark, documents):
    """Two labelled ids on a hundred texts each: five rows are fitted, both ids among them; copies count once."""
    rows = [(1, f"river stone walk light {i}") for i in range(100)] + [(2, f"$$$ !! BUY | {i}") for i in range(100)] + [(1, "river stone")] * 500
    lab = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (1, 1, 1)], "doc_id long, quality int, toxic int")
    for limit in (20, 1000):
        out = quality.score(documents([(8, "river stone walk"), (9, "$$$ !! BUY")]), quality.fit(documents(rows), lab, rows=limit), name="s").toPandas()
        assert out[out.doc_id == 8].s.iloc[0] > 0.5 > out[out.doc_id == 9].s.iloc[0]


def test_names_of_other_columns_do_not_matter(spark, documents):
    rows, labels = corpus(100)
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    d = documents(rows).withColumnsRenamed({"fingerprint": "_quality", "ids": "_id", "rank": "_key", "piece": "_y"})
    out = quality.keep_good(d, lab)
    assert out.columns == d.columns
    got = out.collect()
    assert 0 < len(got) < 100 and all(r["_quality"] == 7 for r in got)


def test_fit_is_the_optimum_of_the_hinge_loss(spark):
    """Ratios by counting in plain Python, and the dual solved by a plain projected ascent over the whole Gram matrix."""
    rows, labels = corpus(60)
    texts, y = [t.encode() for _, t in rows], np.array([2 * v - 1 for _, v, _ in labels])
    doc, slot = quality.features(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0] + [len(t) for t in texts]), 8)
    slots = [slot[doc == i] for i in range(len(texts))]
    count = {v: {} for v in (1, -1)}
    for s, v in zip(slots, y):
        for k in set(s.tolist()):
            count[v][k] = count[v].get(k, 0) + 1
    total = {v: sum(count[v].values()) + 256 for v in (1, -1)}
    ratio = np.array([np.log((1 + count[1].get(k, 0)) / total[1]) - np.log((1 + count[-1].get(k, 0)) / total[-1]) for k in range(256)])
    assert np.allclose(ratio, quality.log_count_ratio(slots, y, 256))
    x = np.zeros((len(y), 257))
    for i, s in enumerate(slots):
        x[i, s] = ratio[s]
        x[i] /= max(np.linalg.norm(x[i]), 1e-12)
        x[i, 256] = 1
    top = np.array([len(y) / (2 * (y == v).sum()) for v in y])
    gram, a = (x * y[:, None]) @ (x * y[:, None]).T, np.zeros(len(y))
    for _ in range(20_000):
        a = np.clip(a - (gram @ a - 1) / np.linalg.norm(gram, 2), 0, top)
    best = (a * y) @ x
    w, b = quality.coordinate_descent(slots, y, ratio, rounds=400)
    loss = lambda w: 0.5 * w @ w + (top * np.maximum(0, 1 - y * (x @ w))).sum()
    assert loss(best) - 1e-6 <= loss(np.append(w, b)) < 1.02 * loss(best)  # the descent ends where no step moves by 1e-3
    assert np.allclose(quality.margins(slots, ratio, w, b), x @ best, atol=0.05)
