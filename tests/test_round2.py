"""Rows without a group, averages, intermediate folders, repeatable clustering."""

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from wardlens import session
from wardlens.operators import evaluate, features, learn, sampling, series
from wardlens.sources import sinks


def test_only_the_average_is_rounded(spark):
    rows = [(1, "a", 0, 1, 1, 1, v) for v in (0.125, 0.135)] + [(2, "a", 0, 1, 1, 1, v) for v in (float("nan"), 4.0, float("inf"), None)]
    h = spark.createDataFrame(rows, "subject_id int, label string, hours_in int, itemid int, icustay_id int, hadm_id int, valuenum double")
    got = {r.subject_id: r for r in series.hourly_average(h).collect()}
    assert got[1].valuenum_avg == 0.13 and got[2].valuenum_avg == 4.0 and got[2].n_measures == 4
    assert {r.valuenum_running_avg for r in series.running_average(h).collect()} == {0.13, 4.0}


def test_rows_without_a_group_stay(spark):
    d = spark.createDataFrame([(i, None if i % 10 == 0 else f"c{i % 2}", i % 3 == 0, float(i % 7)) for i in range(100)],
                              "id int, g string, y boolean, score double").withColumn("y", F.col("y").cast("int"))
    assert sampling.stratified_split(d, "g", "id").count() == 100
    assert sampling.cohort_weights(d, "g").count() == 100
    assert sampling.bootstrap_multiplicity(d, "g", "id", 3).groupBy("replicate").agg(F.sum("multiplicity").alias("n")).filter("n <> 100").isEmpty()
    per = {r.g: r.n_pos + r.n_neg for r in evaluate.auc_by_cohort(d, "g").collect()}
    assert per == {None: 10, "c0": 40, "c1": 50}
    a = sampling.bootstrap_scored(d, "y", "id", 4).groupBy("replicate", "id").agg(F.sum("multiplicity").alias("m"))
    b = sampling.bootstrap_multiplicity(d, "y", "id", 4).groupBy("replicate", "id").agg(F.sum("multiplicity").alias("m"))
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_every_token_is_used(spark):
    rows = [(i, [f"t{j}" for j in range(i * 50, i * 50 + 60)], [f"b0:t{i}"]) for i in range(60)]
    d = spark.createDataFrame(rows, "subject_id int, tokens array<string>, block_tokens array<string>")
    model = learn.fit_embedding(d, 5)
    assert len(model.stages[0].vocabulary) == 59 * 50 + 60 + 60 > 2048
    assert learn.embed(model, d).count() == 60


def test_one_class_and_unseen_cohorts_are_scored(spark):
    rows = [(i, ["a"] if i % 2 else ["b"], int(i % 2), "x") for i in range(40)] + [(100 + i, ["a"], 1, "one") for i in range(10)]
    train = spark.createDataFrame(rows, "subject_id int, tokens array<string>, y int, c string")
    test = spark.createDataFrame([(1, ["a"], "x"), (2, ["b"], "x"), (3, ["a"], "one"), (4, ["z"], "new"), (5, ["a"], None)],
                                 "subject_id int, tokens array<string>, c string")
    got = {r.subject_id: r.score for r in learn.score_global(learn.fit_separate(train, "y", "c"), test, ["subject_id"]).collect()}
    assert set(got) == {1, 2, 3, 4, 5} and got[1] > 0.7 > 0.3 > got[2] and got[3] > 0.6


def test_clusters_do_not_depend_on_the_partitions(spark):
    rng = np.random.default_rng(0)
    rows = [(i, Vectors.dense(((i % 4) * 3 + rng.normal(0, 1, 12)).tolist())) for i in range(300)]
    out = []
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in (8, 32):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            d = spark.createDataFrame(rows, ["subject_id", "embedding"]).repartition(n)
            m = learn.fit_mixture(d, 4, 5, 1e-4, seed=3, block_rows=50)
            assert m.starts_run == 5
            out.append(sorted((r.subject_id, r.cluster) for r in learn.assign_clusters(m, d).collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert out[0] == out[1] and len({c for _, c in out[0]}) == 4


def test_no_local_folder_on_a_cluster(spark):
    class Context:
        master = "yarn"

        def getConf(self):
            return {}

    class Session:
        sparkContext, conf = Context(), {}
    with pytest.raises(RuntimeError):
        session.ensure_checkpoint_dir(Session())


def test_release_deletes_only_intermediate_tables(spark, tmp_path):
    t = sinks.materialize(spark.range(5), "gone")
    files = t.inputFiles()
    sinks.release(t)
    assert not any(__import__("os").path.exists(f.removeprefix("file:").replace("///", "/")) for f in files)
    spark.range(3).write.parquet(str(tmp_path / "own"))
    with pytest.raises(ValueError):
        sinks.release(spark.read.parquet(str(tmp_path / "own")))


def test_unmapped_languages_stay(spark):
    s = spark.createDataFrame([(1, "ENGL"), (2, "XX"), (3, None)], "subject_id int, language string").withColumns(
        {c: F.lit(1) for c in ("age", "los", "readmission_30_days")} | {c: F.lit("v") for c in ("gender", "ethnicity", "insurance", "discharge_location", "first_careunit")}
        | {"hospital_expire_flag": F.lit(0)})
    out = features.static_attributes(s, age_bands=[(0, 5, 1)], los_bands=[(0, 5, 1)], band_default=9, ethnicity_rules=[("v", "V")],
                                     ethnicity_default="O", language_map={"EN": ["ENGL"]})
    assert {r.subject_id: r.language for r in out.collect()} == {1: "EN", 2: "XX", 3: "Missing"}
    with pytest.raises(TypeError):
        features.static_attributes(s, age_band=[])
