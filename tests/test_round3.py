"""Derived tables, stored clusterings, sequence summaries, the once-only run log, trees, clustered files and matrices."""

import os
import tempfile
import threading

import duckdb
import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from wardlens.operators import features, learn, series
from wardlens.plans import experiment
from wardlens.session import ensure_checkpoint_dir
from wardlens.sources import sinks
from wardlens.sources.derived import DerivedTables, files_version


# ---- S3 ----------------------------------------------------------------------------------------

@pytest.fixture
def graph(spark):
    """raw -> doubled -> summed, and raw -> other; ``calls`` lists the builds."""
    root, calls = tempfile.mkdtemp(prefix="wardlens-derived-"), []
    g = DerivedTables(spark, root)
    g.source("raw", lambda: spark.range(10), "v1")

    def noted(name, build):
        return lambda *a, **k: (calls.append(name), build(*a, **k))[1]
    g.table("doubled", noted("doubled", lambda raw, by: raw.select((F.col("id") * by).alias("id"))), ["raw"], {"by": 2})
    g.table("other", noted("other", lambda raw: raw.limit(3)), ["raw"])
    g.table("summed", noted("summed", lambda d: d.agg(F.sum("id").alias("s"))), ["doubled"])
    return g, root, calls


def test_refresh_rebuilds_what_changed_upstream_first(spark, graph):
    g, root, calls = graph
    assert g.refresh("summed") == {"doubled": True, "summed": True} and calls == ["doubled", "summed"]
    assert g.refresh() == {"doubled": False, "other": True, "summed": False}
    assert g.read("summed").first().s == 90
    g.change("doubled", by=3)
    assert g.refresh() == {"doubled": True, "other": False, "summed": True} and g.read("summed").first().s == 135
    again = DerivedTables(spark, root)  # a new job over the same folder finds the published versions
    again.source("raw", lambda: spark.range(10), "v2")
    again.table("other", lambda raw: raw.limit(4), ["raw"])
    assert again.refresh() == {"other": True} and again.read("other").count() == 4
    assert g.drop("doubled") == ["doubled", "summed"]
    with pytest.raises(LookupError):
        g.read("summed")
    assert g.read("other").count() == 4


def test_a_job_that_stops_before_publishing_leaves_the_old_version(graph):
    g, root, _ = graph
    g.refresh()
    g.change("doubled", by=5)
    g.write("doubled")  # ... and is lost here
    assert g.read("doubled").agg(F.sum("id")).first()[0] == 90
    assert g.sweep() == 1 and g.read("summed").first().s == 90
    assert g.refresh() == {"doubled": True, "other": False, "summed": True}
    old = g.read("other")
    assert g.sweep() == 2 and old.count() == 3  # superseded folders went, published ones did not
    for name in ("doubled", "other"):
        g.drop(name)
    g.sweep()
    assert os.listdir(root) == []


def test_readers_find_a_whole_version_while_it_is_replaced(graph):
    g, _, _ = graph
    g.refresh()
    stop, bad = threading.Event(), []

    def watch():
        while not stop.is_set():
            if g.published("doubled") is None:
                bad.append(1)
    t = threading.Thread(target=watch)
    t.start()
    version = g.published("doubled")
    for _ in range(30):
        g.publish("doubled", version)
    stop.set()
    t.join()
    assert not bad


def test_declarations_are_checked(spark, graph):
    g, _, _ = graph
    with pytest.raises(ValueError):
        g.table("early", lambda x: x, ["late"])
    with pytest.raises(ValueError):
        g.table("raw", lambda x: x, [])
    with pytest.raises(ValueError):
        g.table("../out", lambda x: x, [])


def test_version_of_files(spark):
    path = os.path.join(tempfile.mkdtemp(prefix="wardlens-files-"), "t")
    spark.range(5).write.parquet(path)
    first = files_version(spark, path)
    assert files_version(spark, path) == first
    spark.range(1).write.mode("append").parquet(path)
    assert files_version(spark, path) != first


def test_release_all_leaves_no_intermediate_table(spark):
    sinks.release_all(spark)
    sinks.materialize(spark.range(3), "a")
    b = sinks.materialize(spark.range(3), "b")
    sinks.release(b)
    kept = sinks.materialize(spark.range(3), "c", os.path.join(tempfile.mkdtemp(prefix="wardlens-kept-"), "c"))
    folder = os.path.join(ensure_checkpoint_dir(spark), "tables")
    assert sinks.release_all(spark) == 1 and kept.count() == 3
    assert not [f for f in os.listdir(folder) if f.startswith(("a-", "b-"))]


# ---- S8, S9 ------------------------------------------------------------------------------------

def _results(spark, run, value, params="{}"):
    return spark.createDataFrame([(run, params, "GLOBAL", s, "auc", value) for s in ("a", "b", None)],
                                 "run_id string, params string, model string, scope string, metric string, value double")


def test_a_run_is_logged_once(spark):
    path = os.path.join(tempfile.mkdtemp(prefix="wardlens-log-"), "log")
    assert sinks.read_log(spark, path) is None
    threads = [threading.Thread(target=sinks.log_results, args=(_results(spark, f"r{i}", i / 10), path)) for i in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    sinks.log_results(_results(spark, "r1", 0.9), path)
    sinks.log_results(_results(spark, "r1", 0.8, '{"seed":"1"}'), path)  # other parameters: a run of its own
    log = sinks.read_log(spark, path)
    assert log.columns == sinks.RUN_COLUMNS
    assert sorted((r.run_id, r.params, r["count"], r.v) for r in log.groupBy("run_id", "params").agg(F.count("*").alias("count"), F.max("value").alias("v")).collect()) == [
        ("r0", "{}", 3, 0.0), ("r1", '{"seed":"1"}', 3, 0.8), ("r1", "{}", 3, 0.9), ("r2", "{}", 3, 0.2), ("r3", "{}", 3, 0.3)]


# ---- M1 ----------------------------------------------------------------------------------------

def _cells(spark, rows):
    return spark.createDataFrame(rows, "subject_id long, label string, hours_in long, valuenum_avg double")


def test_summaries_equal_regression(spark):
    rng = np.random.default_rng(3)
    rows = [(s, lb, int(h), round(float(v), 2)) for s in range(20) for lb in "abc"
            for h, v in zip(rng.choice(5000, rng.integers(1, 40), replace=False), rng.normal(50, 30, 40))]
    got = {(r.subject_id, r.label): r for r in series.sequence_summaries(_cells(spark, rows)).collect()}
    con = duckdb.connect()
    con.register("pdf", __import__("pandas").DataFrame(rows, columns=["subject_id", "label", "h", "v"]))
    want = con.execute("SELECT subject_id, label, count(*), avg(v), max_by(v, h), regr_slope(v, h) FROM pdf GROUP BY ALL").fetchall()
    assert len(got) == len(want) == 60
    for s, lb, n, mean, last, slope in want:
        r = got[s, lb]
        assert (r.n, r["last"]) == (n, last) and r["mean"] == pytest.approx(mean, abs=1e-9)
        assert (r.slope is None and slope is None) or r.slope == pytest.approx(slope, rel=1e-9, abs=1e-12)


def test_summaries_of_one_hour_of_nulls_and_of_no_rows(spark):
    rows = [(1, "a", 5, 2.5), (1, "a", 6, None), (2, "b", 0, None), (3, "a", 0, 1.0), (3, "a", 2, 2.0), (3, "b", -4, 3.0)]
    got = sorted(map(tuple, series.sequence_summaries(_cells(spark, rows)).collect()), key=str)
    assert got == [(1, "a", 1, 2.5, 2.5, None), (3, "a", 2, 1.5, 2.0, 0.5), (3, "b", 1, 3.0, 3.0, None)]
    vectors = features.summary_vectors(series.sequence_summaries(_cells(spark, rows)), ["a", "b", "c"])
    assert {r.subject_id: r.summary for r in vectors.collect()} == {
        1: [1, 2.5, 2.5, 0, 0, 0, 0, 0, 0, 0, 0, 0], 3: [2, 1.5, 2, 0.5, 1, 3, 3, 0, 0, 0, 0, 0]}
    assert series.sequence_summaries(_cells(spark, [])).count() == 0


def test_values_beyond_exact_sums(spark):
    rows = [(1, "a", 0, 1, 1, 1, v) for v in (1e29, 3e29)] + [(2, "a", 0, 1, 1, 1, v) for v in (1e15, 3.0)] + [(3, "a", 0, 1, 1, 1, 0.125)]
    h = spark.createDataFrame(rows, "subject_id int, label string, hours_in int, itemid int, icustay_id int, hadm_id int, valuenum double")
    assert {r.subject_id: r.valuenum_avg for r in series.hourly_average(h).collect()} == {1: 2e29, 2: (1e15 + 3) / 2, 3: 0.13}
    assert {r.subject_id: r.valuenum_running_avg for r in series.running_average(h).collect()} == {1: 2e29, 2: (1e15 + 3) / 2, 3: 0.13}


# ---- M2, M3, S10 -------------------------------------------------------------------------------

def _points(spark, n=300, seed=0):
    rng = np.random.default_rng(seed)
    return spark.createDataFrame([(i, Vectors.dense(((i % 4) * 3 + rng.normal(0, 1, 6)).tolist())) for i in range(n)], ["subject_id", "embedding"])


def test_groups_of_starts_change_nothing(spark):
    x = _points(spark)
    fits = [learn.fit_mixture(x, 4, 6, 1e-4, seed=3, block_rows=b, groups=g) for b, g in ((1000, 1), (1000, 8), (1000, 3), (100, 1), (100, 8))]
    for f, same in ((fits[1], fits[0]), (fits[2], fits[0]), (fits[4], fits[3])):
        assert all(np.array_equal(getattr(f, c), getattr(same, c)) for c in ("weight", "mean", "root")) and f.steps == same.steps
    assert np.allclose(fits[3].mean, fits[0].mean)


def test_many_blocks_are_added_up_in_a_tree(spark, monkeypatch):
    x = _points(spark)
    plain = learn.fit_mixture(x, 3, 2, 1e-4, seed=1, block_rows=20)
    monkeypatch.setattr(learn, "FAN", 3)
    tree = learn.fit_mixture(x, 3, 2, 1e-4, seed=1, block_rows=20)
    assert np.allclose(plain.mean, tree.mean) and plain.steps == tree.steps


def test_one_step_more_leaves_a_converged_mixture(spark):
    """EM stands still: the M step of the fitted mixture's own sums gives its parameters again."""
    x = _points(spark, 400)
    m = learn.fit_mixture(x, 4, 3, 1e-9, seed=2, max_iter=400)
    z = (np.array([r.embedding.toArray() for r in x.collect()]) - m.center) / m.scale
    log = m.log_density(z)
    r = np.exp(log - learn._log_sum(log)[:, None])
    weight, mean, root = learn._parameters(r.sum(0), r.T @ z, np.stack([(z * r[:, [j]]).T @ z for j in range(4)]), 1e-6)
    assert np.allclose(weight, m.weight, atol=1e-4) and np.allclose(mean, m.mean, atol=1e-3) and np.allclose(root, m.root, atol=1e-2)


def test_a_stored_clustering_assigns_unseen_subjects(spark):
    rows = [(i, [f"t{j}" for j in range(i % 7 + 1)], [f"b{i % 3}:t"], [float(i % 5), 1.0]) for i in range(80)]
    d = spark.createDataFrame(rows, "subject_id int, tokens array<string>, block_tokens array<string>, summary array<double>")
    encoder = learn.fit_embedding(d.filter("subject_id < 60"), 4)
    axes = encoder.stages[-1].pc.toArray()
    assert np.allclose(axes.T @ axes, np.eye(axes.shape[1]), atol=1e-8)  # orthonormal projection axes
    emb = learn.embed(encoder, d)
    mixture = learn.fit_mixture(emb.filter("subject_id < 60"), 3, 4, 1e-4)
    path = tempfile.mkdtemp(prefix="wardlens-clustering-")
    fitted = learn.Clustering(encoder, mixture, ["b", "a"])
    fitted.save(spark, path)
    fitted.save(spark, path)  # again: replaced
    again = learn.Clustering.load(spark, path)
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(again.assign(d)) == key(fitted.assign(d)) == key(learn.assign_clusters(mixture, emb))
    assert again.labels == ["b", "a"] and (again.mixture.steps, again.mixture.starts_run, again.mixture.log_likelihood) == (
        mixture.steps, mixture.starts_run, mixture.log_likelihood)


# ---- M4 ----------------------------------------------------------------------------------------

def test_trees_learn_what_a_linear_model_cannot(spark):
    rows = [(i, [t for t, on in (("a", a), ("b", b)) if on] + ["c"], int(a != b), f"c{i % 2}", "train" if i % 4 else "test")
            for i in range(400) for a, b in [(i // 2 % 2, i // 4 % 2 if i % 3 else i % 2)]]
    d = spark.createDataFrame(rows, "subject_id int, tokens array<string>, y int, c string, split string")
    model_dir, found = tempfile.mkdtemp(prefix="wardlens-trees-"), {}
    for family in ("GLOBAL", "TREES"):
        spec = experiment.ExperimentSpec(model=family, label="y", cohort="c", cohort_as_feature=True)
        out = experiment.run_experiment(d, spec, model_dir=model_dir)
        found[family] = {r.scope: r.value for r in out.collect()}
        assert {r.scope: r.value for r in experiment.run_experiment(d, spec, load_dir=model_dir).collect()} == found[family]
    assert found["TREES"]["micro"] > 0.95 > 0.8 > found["GLOBAL"]["micro"]
    odd = spark.createDataFrame([(1, ["z"], "new"), (2, [], None)], "subject_id int, tokens array<string>, c string")
    scored = learn.score_global(PipelineModel.load(os.path.join(model_dir, "trees")), odd, ["subject_id"]).collect()
    assert len(scored) == 2 and all(0 <= r.score <= 1 for r in scored)


def test_tree_weights_matter(spark):
    rows = [(i, ["a"], int(i < 30), 1.0) for i in range(100)]
    d = spark.createDataFrame(rows, "subject_id int, tokens array<string>, y int, w double")
    heavy = d.withColumn("w", F.when(F.col("y") == 1, 100.0).otherwise(1.0))
    score = [learn.score_global(learn.fit_trees(x, "y", "w"), d.limit(1), ["subject_id"]).first().score for x in (d, heavy)]
    assert score[0] < 0.5 < score[1]


def test_linear_fits_are_stationary(spark):
    """The logistic objective's gradient per weight is near zero over the training rows."""
    rng = np.random.default_rng(4)
    words = ["a", "b", "c", "d"]
    rows = [(i, sorted({words[k] for k in rng.integers(0, 4, 3)}), int(rng.random() < 0.3 + 0.1 * (i % 4)), float(1 + i % 3)) for i in range(300)]
    d = spark.createDataFrame(rows, "subject_id int, tokens array<string>, y int, w double")
    m = learn.fit_global(d, "y", "w")
    vocab, lr = m.stages[0].vocabulary, m.stages[-1]
    x = np.array([[t.count(v) for v in vocab] for _, t, _, _ in rows], float)
    y, w = np.array([r[2] for r in rows], float), np.array([r[3] for r in rows])
    p = 1 / (1 + np.exp(-(x @ lr.coefficients.toArray() + lr.intercept)))
    mean = (w @ x) / w.sum()
    spread = np.sqrt((w @ (x - mean) ** 2) / w.sum() * len(w) / (len(w) - 1))
    spread = np.where(spread > 0, spread, 1)
    gradient = (w * (p - y)) @ x / w.sum() + 0.01 * lr.coefficients.toArray() * spread ** 2
    assert np.abs(gradient).max() < 2e-3 and abs((w * (p - y)).sum() / w.sum()) < 2e-3


# ---- U5, S4, S5, T10 ---------------------------------------------------------------------------

def _table(spark, hot=0):
    rows = [(s, st, f"f{k}") for s in range(60) for st in range(6) for k in range((s * 7 + st) % 4)]
    rows += [(7, st, f"h{k}") for st in range(6) for k in range(hot)]
    return spark.createDataFrame(rows, "subject_id int, step int, feature string")


def test_reading_a_subject_opens_one_file(spark):
    path, t = tempfile.mkdtemp(prefix="wardlens-clustered-"), _table(spark)
    files = sinks.write_clustered(t, path, files=5).orderBy("low").collect()
    assert len(files) > 1 and all(a.high < b.low for a, b in zip(files, files[1:]))
    assert sum(f.n_rows for f in files) == t.count()
    for s in (0, 7, 33, 59):
        own = sinks.read_clustered(spark, path, s, s)
        assert own.count() == t.filter(F.col("subject_id") == s).count()
        assert len(own.inputFiles()) == (1 if own.count() else len(own.inputFiles()))
    assert sinks.read_clustered(spark, path, 1000, 2000).count() == 0
    assert sinks.read_clustered(spark, path, 10, 40).exceptAll(t.filter("subject_id between 10 and 40")).isEmpty()


def test_a_hot_subject_fills_several_files(spark):
    path, t = tempfile.mkdtemp(prefix="wardlens-hot-"), _table(spark, hot=400)
    files = sinks.write_clustered(t, path, order=("step", "feature"), files=6, split_keys=True).collect()
    assert max(f.n_rows for f in files) < t.count() / 3 and sum(f.low <= 7 <= f.high for f in files) > 2
    assert sinks.read_clustered(spark, path, 7, 7).count() == t.filter("subject_id = 7").count()


def test_matrix_round_trip(spark):
    t = _table(spark).unionByName(_table(spark).limit(5))  # repeated cells count once
    names, path = features.feature_names(t), tempfile.mkdtemp(prefix="wardlens-matrix-")
    sinks.write_matrix(features.sequence_matrix(t, names, 6), names, path)
    m, names = (spark.read.parquet(os.path.join(path, x)) for x in ("matrix", "feature_names"))
    for r in m.collect():
        assert len(r.indptr) == 7 and r.indptr[0] == 0 and r.indptr[-1] == len(r.indices) == len(r.data)
        assert all(sorted(set(r.indices[a:b])) == r.indices[a:b] for a, b in zip(r.indptr, r.indptr[1:]))
    back = features.matrix_cells(m, names)
    assert back.exceptAll(t.distinct()).isEmpty() and t.distinct().exceptAll(back).isEmpty()


# ---- E1, W10 -----------------------------------------------------------------------------------

def test_a_pooled_scope_of_continuous_scores_is_cut_into_ranges(spark):
    """No window task sees more than about range_cells cells; AUC and ranks stay exact."""
    from wardlens.operators import evaluate, ranking
    n, limit = 4000, 250
    rng = np.random.default_rng(6)
    score, y = np.round(rng.normal(size=n), 6), rng.integers(0, 2, n)
    d = spark.createDataFrame([(int(i), int(v), float(s)) for i, (v, s) in enumerate(zip(y, score))], "id long, y int, score double")
    order = np.argsort(score, kind="stable")
    rank = np.empty(n)
    for s in np.unique(score):
        at = np.flatnonzero(score[order] == s)
        rank[order[at]] = at.mean() + 1
    want = (rank[y == 1].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (n - y.sum()))
    assert evaluate.auc(d, range_cells=limit).first().auc == pytest.approx(want, abs=1e-12)
    got = {r.id: r.avg_rank for r in evaluate.average_rank(d, range_cells=limit).collect()}
    assert all(got[i] == rank[i] for i in range(n))
    cells = d.groupBy("score").agg(F.count("*").cast("double").alias("n"))
    seen = []
    real = ranking.materialize
    ranking.materialize = lambda df, name: seen.append(out := real(df, name)) or out
    try:
        ranking.sum_before(cells, [], "score", "n", "below", limit)
    finally:
        ranking.materialize = real
    sizes = [r["count"] for r in seen[-1].groupBy("_pid").count().collect()]
    assert len(sizes) >= n // limit - 1 and max(sizes) <= 2 * limit


def test_ranges_keep_null_scopes_and_scopes_that_cross_borders(spark):
    from wardlens.operators.ranking import sum_before
    rows = [(g, float(s), float(s % 3)) for g, m in ((None, 40), ("a", 90), ("b", 1), ("c", 30)) for s in range(m)]
    d = spark.createDataFrame(rows, "g string, score double, n double")
    want = sorted(((g, s, sum(m for h, t, m in rows if h == g and t < s)) for g, s, _ in rows), key=str)
    for limit in (7, 50, 1000):
        got = sum_before(d, ["g"], "score", "n", "below", limit)
        assert sorted(((r.g, r.score, r.below) for r in got.collect()), key=str) == want


# ---- T4 on a stream ----------------------------------------------------------------------------

def _batch_cells(rows, mark):
    """Cells of (microseconds, value) rows that a watermark at ``mark`` has closed."""
    if not rows:
        return {}
    origin, cells = min(t for t, _ in rows), {}
    for t, v in rows:
        cells.setdefault((2 * ((t - origin) // 60_000_000) + 60) // 120, []).append(v)
    return {h: sorted(v) for h, v in cells.items() if origin < mark and origin + (60 * h + 30) * 60_000_000 <= mark}


def test_state_steps_give_the_batch_cells():
    from wardlens.streaming.hourly import advance
    rng = np.random.default_rng(8)
    for _ in range(60):
        delay = int(rng.integers(1, 5_000)) * 1_000_000
        origin, waiting, cells, mark, newest, found, used = None, [], {}, 0, 0, {}, []
        for t in np.cumsum(rng.integers(0, 40, 60)) * 60_000_000 + rng.integers(0, delay, 60):
            t, v = int(t), int(rng.integers(0, 100))
            if t < mark:
                continue  # late
            used.append((t, v))
            origin, waiting, cells, final = advance(origin, [*waiting, (t, [v, 1, 0.0, 0, 1, None, None])], cells, mark)
            newest = max(newest, t)
            found |= dict(final)
            mark = max(mark, newest - delay)
            origin, waiting, cells, final = advance(origin, waiting, cells, mark)
            assert not found.keys() & {h for h, _ in final}  # a final cell never comes back
            found |= dict(final)
        want = _batch_cells(used, mark)
        assert {h: (c[0], c[1]) for h, c in found.items()} == {h: (sum(v), len(v)) for h, v in want.items()}


def test_stream_drops_late_rows_and_goes_on_after_a_stop(spark):
    from wardlens.streaming.hourly import stream_hourly
    schema = "subject_id long, label string, charttime timestamp_ntz, valuenum double, icustay_id long, hadm_id long"
    base = tempfile.mkdtemp(prefix="wardlens-hourly-")
    at = lambda minutes: f"2024-01-01 {minutes // 60:02d}:{minutes % 60:02d}:00"

    def add(rows):
        d = spark.createDataFrame([(s, "hr", at(m), v, 7, None) for s, m, v in rows], schema.replace("timestamp_ntz", "string"))
        d.withColumn("charttime", F.col("charttime").cast("timestamp_ntz")).write.mode("append").parquet(os.path.join(base, "in"))

    def run():
        stream_hourly(spark.readStream.schema(schema).parquet(os.path.join(base, "in")), os.path.join(base, "out"), os.path.join(base, "progress"), "1 hour").awaitTermination()
        return sorted(((r.subject_id, r.hours_in, r.valuenum_avg, r.n_measures, r.icustay_id, r.hadm_id) for r in spark.read.parquet(os.path.join(base, "out")).collect()), key=str)

    add([(1, 60, 1.0), (1, 70, 2.0), (1, 100, 5.0), (2, 61, None)])
    assert run() == []  # the watermark stands at 00:40
    add([(1, 95, 6.0), (1, 240, 9.0), (None, 245, 4.0)])  # 01:35 is in time; the watermark comes to 03:05
    assert run() == [(1, 0, 1.5, 2, 7, None), (1, 1, 5.5, 2, 7, None), (2, 0, None, 1, 7, None)]
    add([(1, 62, 100.0), (1, 241, 10.0), (2, 600, 3.0)])  # 01:02 is late; the watermark comes to 09:00
    assert run() == [(1, 0, 1.5, 2, 7, None), (1, 1, 5.5, 2, 7, None), (1, 3, 9.5, 2, 7, None), (2, 0, None, 1, 7, None), (None, 0, 4.0, 1, 7, None)]
