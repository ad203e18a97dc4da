"""Inline edge cases (FIXTURES.md §1) for cohort, series, feature and evaluation operators."""

from datetime import date, datetime, timedelta

from pyspark.sql import functions as F

from wardlens.functions.codesets import CLINICAL, only
from wardlens.functions.scalar import band, category_by_substring, zscore_word
from wardlens.operators import cohort, evaluate, features, flags, sampling, series

T0 = datetime(2020, 1, 1, 0, 0)
STAY_SCHEMA = ("subject_id long, hadm_id long, icustay_id long, first_careunit string, "
               "intime timestamp_ntz, outtime timestamp_ntz, los double")


def _stays(spark, rows):
    return spark.createDataFrame(rows, STAY_SCHEMA)


def _subjects(spark, ids, dob=date(1950, 1, 1)):
    return spark.createDataFrame([(i, "F", dob) for i in ids], "subject_id long, gender string, dob date")


def _visits(spark, rows):
    return spark.createDataFrame(
        [(s, h, T0, "HOME", "ENGL", "Medicare", "WHITE", T0) for s, h in rows],
        "subject_id long, hadm_id long, admittime timestamp_ntz, discharge_location string, "
        "language string, insurance string, ethnicity string, dischtime timestamp_ntz")


def _deaths(spark):
    return spark.createDataFrame([], "subject_id long, hadm_id long, deathtime timestamp_ntz, "
                                     "hospital_expire_flag int")


def _index(spark, stays, **kw):
    ids = sorted({r[0] for r in stays})
    visits = [(r[0], r[1]) for r in stays]
    params = dict(CLINICAL)
    params.update(kw)
    return cohort.index_stays(_stays(spark, stays), _subjects(spark, ids), _visits(spark, visits),
                              _deaths(spark), **only(cohort.index_stays, params))


def _rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_return_label_day_rounding(spark):
    end = T0 + timedelta(days=2)
    gaps = {1: timedelta(hours=11, minutes=59), 2: timedelta(hours=12), 3: timedelta(days=29, hours=12),
            4: -timedelta(days=1)}
    stays = []
    for s, g in gaps.items():
        stays.append((s, 10 * s, 10 * s, "MICU", T0, end, 2.0))
        stays.append((s, 10 * s + 1, 10 * s + 1, "MICU", end + g, end + g + timedelta(days=30), 1.0))
    stays.append((5, 50, 50, "MICU", T0, end, 2.0))  # only one stay
    out = _index(spark, stays)
    got = _rows(out, "subject_id", "days_since_discharge", "readmission_30_days")
    assert got == [(1, 0, 0), (2, 1, 1), (3, 30, 0), (4, -1, 0), (5, 0, 0)]


def test_ties_and_null_end_and_excluded_unit(spark):
    e = T0 + timedelta(days=1)
    stays = [
        (1, 11, 11, "MICU", T0, e, 1.0), (1, 12, 12, "MICU", T0, e, 1.0),  # tie on end time
        (2, 21, 21, "MICU", T0, None, 1.0), (2, 22, 22, "MICU", T0, e, 1.0),  # null end sorts last
        (3, 31, 31, "NICU", T0, T0, 1.0), (3, 32, 32, "MICU", T0, e, 1.0),  # excluded first unit
    ]
    one = _index(spark, stays)
    assert _rows(one, "subject_id", "hadm_id") == [(1, 11), (2, 22), (3, 32)]
    ties = _index(spark, stays, keep_ties=True)
    assert _rows(ties, "subject_id", "hadm_id") == [(1, 11), (1, 12), (2, 22), (3, 32)]


def test_age_strictly_above(spark):
    start = datetime(2018, 1, 1)
    dob_days = 18 * 365242 // 1000 + 1  # 6575 days -> 18.00 years after rounding
    stays = [(1, 1, 1, "MICU", start, start + timedelta(days=1), 1.0)]
    ids = [1]
    out = cohort.index_stays(_stays(spark, stays), _subjects(spark, ids, (start - timedelta(days=dob_days)).date()),
                             _visits(spark, [(1, 1)]), _deaths(spark), **only(cohort.index_stays, CLINICAL))
    assert out.count() == 0
    age = out.select("age").collect()
    assert age == []


def test_subject_without_codes_gets_zero_flags(spark):
    e = T0 + timedelta(days=1)
    stays = _stays(spark, [(1, 11, 11, "MICU", T0, e, 1.0), (2, 21, 21, "MICU", T0, e, 1.0)])
    dct = spark.createDataFrame([("4280", "heart failure"), ("1530", "Malignant neoplasm of colon, malignant"),
                                 ("1531", "malignant growth, benign")], "icd9_code string, long_title string")
    facts = spark.createDataFrame([(1, 11, "4280"), (1, 11, "1530")], "subject_id long, hadm_id long, icd9_code string")
    out = flags.first_visit_flags(stays, dct, facts, excluded_units=["NICU"], code_flags=CLINICAL["code_flags"],
                                  title_flag=CLINICAL["title_flag"], lowercase_flags=CLINICAL["lowercase_flags"])
    got = {r["subject_id"]: (r["congestive_heart_failure"], r["cancer"], r["copd"]) for r in out.collect()}
    assert got == {1: (1, 1, 0), 2: (0, 0, 0)}
    t = flags.title_flags(dct, "cancer", "malignant").collect()
    assert {r["icd9_code"]: r["cancer"] for r in t} == {"4280": 0, "1530": 1, "1531": 0}


def _meas(spark, rows):
    return spark.createDataFrame(rows, "subject_id long, hadm_id long, icustay_id long, label string, "
                                       "itemid long, charttime timestamp_ntz, valuenum double")


def test_hours_round_half_away(spark):
    m = _meas(spark, [(1, 1, 1, "hr", 1, T0, 1.0), (1, 1, 1, "hr", 1, T0 + timedelta(minutes=29), 2.0),
                      (1, 1, 1, "hr", 1, T0 + timedelta(minutes=30), 3.0)])
    got = _rows(series.with_hours(m), "valuenum", "hours_in")
    assert got == [(1.0, 0), (2.0, 0), (3.0, 1)]


def test_hourly_plain_mean_and_running_mean_by_item(spark):
    m = _meas(spark, [(1, 1, 1, "hr", 2, T0, 10.0), (1, 1, 1, "hr", 1, T0 + timedelta(minutes=5), 20.0),
                      (1, 1, 1, "hr", 2, T0 + timedelta(minutes=6), 40.0)])
    h = series.with_hours(m)
    cells = series.hourly_average(h).collect()
    assert len(cells) == 1 and abs(cells[0]["valuenum_avg"] - 23.33) < 1e-9
    run = _rows(series.running_average(h), "itemid", "valuenum", "valuenum_running_avg")
    assert run == [(1, 20.0, 20.0), (2, 10.0, 23.33), (2, 40.0, 23.33)]


def _cells(spark, hours_by_subject):
    rows = [(s, 1, 1, "hr", h, 1.0, 1) for s, hs in hours_by_subject.items() for h in hs]
    return spark.createDataFrame(rows, "subject_id long, icustay_id long, hadm_id long, label string, "
                                       "hours_in long, valuenum_avg double, n_measures long")


def test_min_span_and_slots(spark):
    cells = _cells(spark, {1: [0, 47], 2: [10, 47, 50]})
    kept = series.min_span(cells, 48).select("subject_id").distinct().collect()
    assert [r[0] for r in kept] == [2]
    slots = series.hourly_slots(series.trailing_window(cells, 48), 48)
    got = _rows(slots.filter("subject_id = 2"), "hours_in", "src_hour", "step")
    assert len(got) == 48 and got[0] == (3, 10, 0) and got[-1] == (50, 50, 47)
    assert {h: s for h, s, _ in got}[11] == 47 and {h: s for h, s, _ in got}[48] == 50


def test_zscore_word_rounding_and_clip(spark):
    df = spark.createDataFrame([(0.5,), (1.5,), (-2.5,), (7.0,), (None,)], "z double")
    out = df.select(zscore_word(F.col("z"), F.lit(0.0), F.lit(1.0)).alias("w")).collect()
    assert [r["w"] for r in out] == [0, 2, -2, 4, None]
    zero = spark.createDataFrame([(5.0,), (6.0,)], "x double") \
        .select(zscore_word(F.col("x"), F.lit(5.0), F.lit(0.0)).alias("w")).collect()
    assert [r["w"] for r in zero] == [None, 4]


def test_bands(spark):
    ages = spark.createDataFrame([(10.0,), (30.0,), (30.01,), (70.0,), (70.01,), (None,)], "a double")
    got = [r[0] for r in ages.select(band("a", CLINICAL["age_bands"], 4)).collect()]
    assert got == [4, 1, 2, 3, 4, 4]
    los = spark.createDataFrame([(x,) for x in (1.0, 15.0, 15.5, 16.5, 30.5, 45.0, 46.0)], "l double")
    got = [r[0] for r in los.select(band("l", CLINICAL["los_bands"], 4)).collect()]
    assert got == [4, 1, 4, 2, 4, 3, 4]
    eth = spark.createDataFrame([("CAUCASIAN",), ("WHITE - RUSSIAN",), ("HISPANIC WHITE",), ("UNKNOWN",)], "e string")
    got = [r[0] for r in eth.select(category_by_substring("e", CLINICAL["ethnicity_rules"])).collect()]
    assert got == ["ASIAN", "WHITE", "WHITE", "OTHER"]


def test_auc_ties_and_one_class(spark):
    df = spark.createDataFrame([(0.1, 0, "a"), (0.4, 0, "a"), (0.35, 1, "a"), (0.8, 1, "a"), (0.4, 1, "a"),
                                (0.5, 1, "b"), (0.7, 1, "b")], "score double, y int, c string")
    overall = evaluate.auc(df.filter("c = 'a'")).collect()[0]
    assert overall["auc"] == 0.75
    per = {r["c"]: r["auc"] for r in evaluate.auc_by_cohort(df, "c").collect()}
    assert per == {"a": 0.75, "b": None}


def test_auc_matches_evaluator(spark):
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    rows = [(float((i * 37) % 17) / 17, int((i * 13) % 5 < 2)) for i in range(300)]
    df = spark.createDataFrame(rows, "score double, y int")
    ours = evaluate.auc(df).collect()[0]["auc"]
    ev = BinaryClassificationEvaluator(rawPredictionCol="score", labelCol="y", numBins=0)
    ref = ev.evaluate(df.withColumn("y", F.col("y").cast("double")))
    assert abs(ours - ref) < 1e-12


def test_split_exact_counts_and_draws(spark):
    df = spark.range(0, 1003).select(F.col("id").alias("sid"), (F.col("id") % 7 == 0).cast("int").alias("y"))
    out = sampling.stratified_split(df, "y", "sid", seed=3, buckets=16)
    counts = {(r["y"], r["split"]): r["count"] for r in out.groupBy("y", "split").count().collect()}
    for y in (0, 1):
        n = sum(v for (yy, _), v in counts.items() if yy == y)
        n_test = -(-n // 5)
        assert counts[(y, "test")] == n_test
        assert counts[(y, "val")] == -(-(n - n_test) // 8)
    ranks = out.groupBy("y").agg(F.min("rank"), F.max("rank"), F.countDistinct("rank"), F.count("*")).collect()
    for r in ranks:
        assert r[1] == 0 and r[2] == r[4] - 1 and r[3] == r[4]
    draws = sampling.bootstrap_draws(df, "y", "sid", 5, seed=1, buckets=16)
    sizes = draws.groupBy("replicate", "y").count().collect()
    base = {r["y"]: r["count"] for r in sizes if r["replicate"] == 0}
    assert all(r["count"] == base[r["y"]] for r in sizes)
    rep0 = sampling.bootstrap_sample(df, draws, "sid", 0)
    assert rep0.count() == 1003


def test_not_in_with_null(spark):
    c = spark.createDataFrame([(1,), (2,)], "subject_id long")
    m_null = spark.createDataFrame([(1,), (None,)], "subject_id long")
    m = spark.createDataFrame([(1,)], "subject_id long")
    assert series.no_measurement_subjects(c, m_null).count() == 0
    assert [r[0] for r in series.no_measurement_subjects(c, m).collect()] == [2]


def test_one_hot_skips_missing_and_collapses(spark):
    w = spark.createDataFrame([(1, 5, "hr", 1), (1, 5, "hr", 1), (1, 5, "bp", None)],
                              "subject_id long, hours_in long, label string, word int")
    out = features.one_hot_words(w).collect()
    assert [r["feature"] for r in out] == ["hr_1"]


def test_code_flags_keeps_unused_dictionary_codes(spark):
    dct = spark.createDataFrame([("4280", "heart failure"), ("490", "bronchitis"), ("999", "x malignant")],
                                "icd9_code string, long_title string")
    facts = spark.createDataFrame([(1, 11, "490"), (1, 11, "490"), (2, 21, "777")],
                                  "subject_id long, hadm_id long, icd9_code string")
    out = flags.code_flags(dct, facts, code_flags=CLINICAL["code_flags"], title_flag=CLINICAL["title_flag"],
                           lowercase_flags=CLINICAL["lowercase_flags"])
    got = sorted((r["subject_id"] or 0, r["icd9_code"] or "", r["long_title"], r["congestive_heart_failure"],
                  r["copd"], r["cancer"]) for r in out.collect())
    # the unused heart-failure code is flagged from the dictionary side; copd reads the fact's code
    assert got == [(0, "", "heart failure", 1, 0, 0), (0, "", "x malignant", 0, 0, 1),
                   (1, "490", "bronchitis", 0, 1, 0), (1, "490", "bronchitis", 0, 1, 0)]


def test_running_max_binary_equals_window(spark):
    rows = [(1, 3, 0), (1, 1, 0), (1, 2, 1), (1, 2, 0), (1, None, 0), (2, 5, 0), (2, None, 1), (3, 1, 1)]
    df = spark.createDataFrame(rows, "s long, o long, f int")
    def key(r):
        return tuple((x is None, x or 0) for x in r)
    a = sorted((tuple(r) for r in flags.running_max(df, "s", "o", ["f"]).collect()), key=key)
    b = sorted((tuple(r) for r in flags.running_max(df, "s", "o", ["f"], binary=False).collect()), key=key)
    assert a == b


def test_hours_from_subject_origin_and_language_map(spark):
    m = _meas(spark, [(1, 1, 1, "hr", 1, T0, 1.0), (1, 1, 1, "bp", 1, T0 + timedelta(hours=2), 2.0)])
    per_label = _rows(series.with_hours(m), "label", "hours_in")
    per_subject = _rows(series.with_hours(m, origin="subject"), "label", "hours_in")
    assert per_label == [("bp", 0), ("hr", 0)] and per_subject == [("bp", 2), ("hr", 0)]
    st = spark.createDataFrame([(1, "F", 40.0, "WHITE", 3.0, None, "Medicare", "HOME", "MICU", 0, None),
                                (2, "M", 20.0, "ASIAN", 20.0, "ENGL", "Private", "SNF", "SICU", 1, 1)],
                               "subject_id long, gender string, age double, ethnicity string, los double, "
                               "language string, insurance string, discharge_location string, "
                               "first_careunit string, readmission_30_days int, hospital_expire_flag int")
    out = features.static_attributes(st, **only(features.static_attributes, CLINICAL) | {"language_map": {"English": ["ENGL"]}}).collect()
    assert [(r["subject_id"], r["language"], r["age"], r["los"]) for r in out] == [(1, "Missing", 2, 1)]


def test_one_pass_slots_equal_window_chain(spark):
    cells = _cells(spark, {1: [0, 20, 49, 60], 2: [10, 47, 50], 3: [48], 4: list(range(100, 160, 7))})
    trail = series.trailing_window(cells, 48)
    chain = series.clip_last(series.fill_backward(series.regularize(trail, 48)), 48)
    cols = ["subject_id", "hours_in", "last_hour", "observed", "src_hour", "step"]
    a = sorted(tuple(r) for r in series.hourly_slots(trail, 48).select(*cols).collect())
    b = sorted(tuple(r) for r in chain.select(*cols).collect())
    assert a == b and len(a) == 4 * 48


def test_average_rank_ties_and_nulls(spark):
    df = spark.createDataFrame([(1, 0.1), (2, 0.4), (3, 0.35), (4, 0.8), (5, 0.4), (6, None)], "id long, score double")
    got = {r["id"]: r["avg_rank"] for r in evaluate.average_rank(df, "score", range_cells=2).collect()}
    assert got == {1: 1.0, 2: 3.5, 3: 2.0, 4: 5.0, 5: 3.5, 6: None}


def test_bootstrap_multiplicity_equals_counted_draws(spark):
    df = spark.range(0, 257).select(F.col("id").alias("sid"), (F.col("id") % 5 == 0).cast("int").alias("y"))
    a = sorted(tuple(r) for r in sampling.bootstrap_multiplicity(df, "y", "sid", 7, seed=2, buckets=8)
               .select("replicate", "sid", "multiplicity").collect())
    b = sorted(tuple(r) for r in sampling.draw_multiplicity(sampling.bootstrap_draws(df, "y", "sid", 7, seed=2, buckets=8),
                                                            "sid").select("replicate", "sid", "multiplicity").collect())
    assert a == b and sum(m for _, _, m in a) == 7 * 257
