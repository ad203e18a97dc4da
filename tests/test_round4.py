"""Plans that hold on larger tables: token rows stay off the driver, draws are dealt by count, rows are scored once."""

import pytest
from pyspark.sql import functions as F

from wardlens.operators import cohort, features, flags, learn, sampling, series
from wardlens.plans import experiment, q_learn


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def token_rows(spark, tmp_path):
    """Rows whose files are far smaller than their token lists."""
    path = str(tmp_path / "rows")
    tokens = F.array_repeat(F.lit("a-token-that-repeats"), 500)
    spark.range(200).select(F.col("id").alias("subject_id"), tokens.alias("tokens"), tokens.alias("block_tokens"), (F.col("id") % 2).cast("int").alias("y"),
                            F.concat(F.lit("u"), F.col("id") % 3).alias("unit")).write.parquet(path)
    return spark.read.parquet(path)


def test_token_rows_are_never_broadcast(spark, token_rows):
    other = spark.range(200).select(F.col("id").alias("subject_id"), (F.col("id") % 4).alias("cluster"))
    for out in (learn.join_tokens(token_rows, other), experiment.with_cohorts(token_rows, other)):
        assert "BroadcastHashJoin" not in _plan(out) and "SortMergeJoin" in _plan(out)
        assert out.count() == 200


def test_cohort_counts_are_the_broadcast_side(token_rows):
    out = sampling.cohort_weights(token_rows, "unit")
    assert "BuildRight" in _plan(out) and out.count() == 200


def test_draws_are_dealt_by_their_number(spark, monkeypatch):
    monkeypatch.setattr(sampling, "TASK_DRAWS", 1_000)
    scored = spark.range(300).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("y"))
    ranked = sampling.class_ranks(scored, "y", "doc_id", 0)
    positions = sampling._positions(ranked, "y", 50)
    sizes = [r["count"] for r in positions.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 300 * 49 and len(sizes) > 8 and max(sizes) < 3_000
    per = sampling.bootstrap_multiplicity(scored, "y", "doc_id", 50).groupBy("replicate").agg(F.sum("multiplicity").alias("n")).collect()
    assert {r["n"] for r in per} == {300} and len(per) == 50


def test_fits_keep_only_what_they_read(token_rows, monkeypatch):
    kept, persisted = [], learn._persisted
    monkeypatch.setattr(learn, "_persisted", lambda df: (kept.append(df.columns), persisted(df))[1])
    learn.fit_global(token_rows, "y")
    learn.fit_multitask(token_rows, "y", "unit")
    assert kept == [["tokens", "y"], ["tokens", "y", "unit"]]


def test_model_rows_split_does_not_collect_tokens(spark, monkeypatch):
    from wardlens.sources.tables import Tables
    seen, split = [], sampling.stratified_split
    monkeypatch.setattr(q_learn.SA, "stratified_split", lambda df, *a, **k: (seen.append(_plan(df)), split(df, *a, **k))[1])
    rows = q_learn.fixture_model_rows(Tables(spark, "/root/testdata/sf0.001"))
    assert rows.columns == ["subject_id", "tokens", "block_tokens", q_learn.LABEL, q_learn.COHORT, "split"]
    assert "Exchange" not in seen[0]  # a scan of the written subjects


def test_tables_that_grow_are_never_broadcast(spark):
    """Small files of subjects, cells or codes do not make a plan send them whole through the driver."""
    ids = spark.range(40).select(F.col("id").alias("subject_id"), F.col("id").alias("hadm_id"), F.col("id").alias("icustay_id"))
    at = lambda days: F.expr(f"timestamp'2020-01-01' + make_dt_interval({days})")
    stays = ids.select("*", F.lit("u").alias("first_careunit"), at("1").alias("intime"), at("2").alias("outtime"), F.lit(1.0).alias("los"))
    subjects = ids.select("subject_id", F.lit("g").alias("gender"), F.lit("1970-01-01").cast("date").alias("dob"))
    visits = ids.select("subject_id", "hadm_id", *(F.lit("x").alias(c) for c in ("discharge_location", "language", "insurance", "ethnicity")),
                        at("1").alias("admittime"), at("2").alias("dischtime"))
    deaths = ids.select("subject_id", "hadm_id", at("9").alias("deathtime"), F.lit(0).alias("hospital_expire_flag")).filter("subject_id < 5")
    index = cohort.index_stays(stays, subjects, visits, deaths, excluded_units=["none"], discharge_buckets={"HOME": ["x"]})

    codes = spark.range(20).select(F.col("id").cast("string").alias("icd9_code"), F.lit("a title").alias("long_title"))
    facts = ids.select("subject_id", "hadm_id", (F.col("subject_id") % 20).cast("string").alias("icd9_code"))
    flagged = flags.first_visit_flags(stays, codes, facts, excluded_units=["none"], code_flags={"copd": ["3"]}, title_flag=None)

    cells = ids.select("subject_id", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("hours_in"), F.lit("hr").alias("label"), F.lit(1.0).alias("valuenum_avg"))
    trailing = series.trailing_window(cells, 2)
    slots = series.hourly_slots(trailing, 2)
    words = features.sequence_words(slots, cells.select("subject_id", "hours_in", F.lit("hr_1").alias("feature")))
    static = ids.select("subject_id", F.lit("g").alias("gender"))
    static = static.select("*", *(F.lit("s").alias(c) for c in features.STATIC_COLUMNS if c != "gender"))
    table = features.feature_table(words, static, flagged, ["copd"], 2)

    for out, rows in ((index, 40), (flagged, 40), (trailing, 120), (table, 40 * 2 * (len(features.STATIC_COLUMNS) + 1) + 2 * 2)):
        assert "BroadcastHashJoin" not in _plan(out) and "SortMergeJoin" in _plan(out)
        assert out.count() == rows


@pytest.mark.parametrize("small_parts", [4, 8])
def test_lookups_of_draws_are_dealt_by_their_number(spark, monkeypatch, small_parts):
    """no task looks up more draws than it may make, however few bytes they are."""
    from wardlens.operators import evaluate
    monkeypatch.setattr(sampling, "TASK_DRAWS", 1_000)
    unit = F.when(F.col("id") % 3 > 0, F.concat(F.lit("u"), F.col("id") % 3))
    y = F.when(F.col("id") % 10 > 0, F.col("id") % 2).cast("int")  # rows without a label are a class
    scored = spark.range(300).select(F.col("id").alias("doc_id"), y.alias("y"), unit.alias("unit"), (F.col("id") % 7 / 7).alias("score"))
    draws = sampling.bootstrap_draws(scored, "y", "doc_id", 50)
    counted = sampling.draw_multiplicity(draws, "doc_id").collect()
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", small_parts)
    try:
        mult = sampling.bootstrap_multiplicity(scored, "y", "doc_id", 50)
        looked = sampling.bootstrap_scored(scored, "y", "doc_id", 50).filter("replicate > 0")
        joined = scored.join(mult, "doc_id")  # the join of evaluate.auc_bootstrap
        for df, least in ((mult, 12), (looked, 12), (joined, 12)):
            sizes = [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]
            assert len(sizes) >= least and max(sizes) < 2_000, sizes
        assert sorted(map(tuple, mult.collect())) == sorted(map(tuple, counted))
        assert evaluate.auc_bootstrap(scored, mult, "doc_id", "unit", summary=False).count() == 50 * 3
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_a_subjects_labels_share_a_call(spark, tmp_path):
    """the stream's state is keyed by subject; labels, a NULL one included, keep origins and cells of their own."""
    from wardlens.streaming.hourly import hourly_cells, stream_hourly
    schema = "subject_id long, label string, charttime timestamp_ntz, valuenum double, icustay_id long, hadm_id long"
    base = str(tmp_path)
    rows = [(1, "a", 0, 1.0), (1, "b", 90, 2.0), (1, None, 30, 3.0), (1, "a", 20, 3.0), (1, "b", 185, 4.0), (2, "a", 600, 1.0)]
    frame = spark.createDataFrame([(i, lb, f"2024-01-01 {m // 60:02d}:{m % 60:02d}:00", v, 7, None) for i, lb, m, v in rows], schema.replace("timestamp_ntz", "string"))
    frame.withColumn("charttime", F.col("charttime").cast("timestamp_ntz")).write.parquet(base + "/in")
    stream = spark.readStream.schema(schema).parquet(base + "/in")
    keys = _plan_keys(hourly_cells(stream))
    assert "subject_id" in keys and "label" not in keys
    stream_hourly(stream, base + "/out", base + "/progress", "1 hour").awaitTermination()
    got = spark.read.parquet(base + "/out").select("subject_id", "label", "hours_in", "valuenum_avg", "n_measures").collect()
    assert sorted(map(tuple, got), key=str) == [(1, "a", 0, 2.0, 2), (1, "b", 0, 2.0, 1), (1, "b", 2, 4.0, 1), (1, None, 0, 3.0, 1)]


def _plan_keys(stream):
    """The grouping keys of the stateful step, as the analysed plan names them."""
    import re
    return re.search(r"FlatMapGroupsInPandasWithState [^\[]*\[([^\]]*)\]", stream._jdf.queryExecution().analyzed().toString()).group(1)


def test_products_read_written_vectors(spark, monkeypatch):
    """the jobs of the iteration carry the lineage of a scan, not of the steps that made the vectors."""
    seen, matrix = [], learn.RowMatrix
    monkeypatch.setattr(learn, "RowMatrix", lambda rows: (seen.append(rows._jdf.queryExecution().optimizedPlan().toString()), matrix(rows))[1])
    kept = []
    monkeypatch.setattr(learn, "release", lambda table: kept.append(table.inputFiles()))
    tokens = F.array(F.concat(F.lit("a"), F.col("id") % 7), F.concat(F.lit("b"), F.col("id") % 5))
    rows = spark.range(60).select(F.col("id").alias("subject_id"), tokens.alias("tokens"), tokens.alias("block_tokens"))
    model = learn.fit_embedding(rows.join(spark.range(60).withColumnRenamed("id", "subject_id").hint("merge"), "subject_id"), 3)
    assert learn.embed(model, rows).count() == 60
    assert len(seen) == 1 and "FileScan" in seen[0] and "Join" not in seen[0] and "UDF(_emb" not in seen[0]
    assert len(kept) == 1 and kept[0]  # and released afterwards


def test_rows_of_the_encoder_are_written_once(spark):
    """what the fit and the embedding read is joined once, and so are the parts of the feature table."""
    from wardlens.sources.tables import Tables
    t = Tables(spark, "/root/testdata/sf0.001")
    rows = q_learn._encoder_rows(t)
    assert "Join" not in _plan(rows) and q_learn._encoder_rows(t) is rows
    assert {"seq_words", "static", "encoder_rows"} <= set(t._cache)
    whole = learn.join_tokens(q_learn.fixture_model_rows(t), features.summary_vectors(series.sequence_summaries(q_learn.fixture_trailing(t)), q_learn.LABELS))
    assert rows.columns == whole.columns and sorted(map(str, rows.collect())) == sorted(map(str, whole.collect()))


def test_rows_of_cluster_cohorts_are_written_once(spark, monkeypatch):
    """the fit's jobs and the scoring read one written join."""
    seen = []
    monkeypatch.setattr(q_learn, "_membership", lambda t: q_learn.fixture_model_rows(t).select("subject_id", (F.col("subject_id") % 4).alias("cluster")))
    monkeypatch.setattr(q_learn.X, "run_experiment", lambda rows, spec: seen.append(rows))
    q_learn.cluster_cohort_models(spark, "/root/testdata/sf0.001")
    rows = seen[0]
    assert "Join" not in _plan(rows) and {"subject_id", "tokens", "cluster", "split"} <= set(rows.columns)
    assert rows.filter(F.col("cluster") != (F.col("subject_id") % 4).cast("string")).count() == 0
