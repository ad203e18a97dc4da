"""Queries of build step 5: words, static attributes and the model table."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardlens.functions.codesets import FIXTURE, only
from wardlens.functions.scalar import band, category_by_substring
from wardlens.operators import features as FE
from wardlens.operators import flags
from wardlens.operators import series
from wardlens.plans import q_flags
from wardlens.plans import sqltext as S
from wardlens.plans.catalog import register
from wardlens.plans.q_cohort import fixture_index_stays, fixture_stays
from wardlens.plans.q_series import N, SERIES_CTES, fixture_cohort, fixture_trailing
from wardlens.sources import roles
from wardlens.sources.tables import Tables

P = FIXTURE
LIMIT = P["z_limit"]


# ---- Spark side ----------------------------------------------------------

def fixture_words(t: Tables):
    trail = fixture_trailing(t)
    return FE.zscore_words(trail, FE.feature_stats(trail), LIMIT)


def fixture_seq_words(t: Tables):
    trail = fixture_trailing(t)
    words = FE.zscore_words(trail, FE.feature_stats(trail), LIMIT)
    return FE.sequence_words(series.hourly_slots(trail, N), FE.one_hot_words(words))


def fixture_static(t: Tables):
    return FE.static_attributes(fixture_cohort(t), **only(FE.static_attributes, P))


def fixture_flags(t: Tables):
    return t.derived("first_visit_flags", lambda: flags.first_visit_flags(
        fixture_stays(t), roles.code_dictionary(t), roles.code_facts(t),
        excluded_units=P["excluded_units"], **q_flags._kw()))


def fixture_table(t: Tables, side_by_side: bool = True):
    if side_by_side:
        # flags and the measurement chain only share the stay table
        fixture_stays(t)
        t.prefetch(lambda: fixture_flags(t), lambda: fixture_trailing(t))
    # each part is read several times below: written once, and the plans on the table stay short
    words, static = t.derived("seq_words", lambda: fixture_seq_words(t)), t.derived("static", lambda: fixture_static(t))
    return FE.feature_table(words, static, fixture_flags(t), q_flags.NAMES, N)


# ---- oracle side ---------------------------------------------------------

def _band_sql(col: str, bands, default: int) -> str:
    parts = " ".join(f"WHEN {col} > {lo} AND {col} <= {hi} THEN {v}" for lo, hi, v in bands)
    return f"CAST(CASE {parts} ELSE {default} END AS INTEGER)"


def _category_sql(col: str) -> str:
    parts = " ".join(f"WHEN contains(coalesce({col}, ''), {S.q(n)}) THEN {S.q(lb)}"
                     for n, lb in P["ethnicity_rules"])
    return f"CASE {parts} ELSE {S.q(P['ethnicity_default'])} END"


FEATURE_CTES = SERIES_CTES + ",\n" + q_flags._FIRST_SQL + f""",
fvf AS (SELECT f.subject_id, f.hadm_id, {", ".join(f"CAST(coalesce(pv.{n}, 0) AS INTEGER) AS {n}" for n in q_flags.NAMES)}
  FROM first_st f LEFT JOIN pv ON f.subject_id = pv.subject_id AND f.hadm_id = pv.hadm_id),
st AS (SELECT m.label, m.mean, s.std
  FROM (SELECT label, avg(sm) AS mean FROM (SELECT subject_id, label, avg(valuenum_avg) AS sm FROM trail GROUP BY subject_id, label) GROUP BY label) m
  FULL JOIN (SELECT label, stddev_samp(valuenum_avg) AS std FROM trail GROUP BY label) s ON m.label = s.label),
words AS (
  SELECT t.subject_id, t.hours_in, t.label, t.valuenum_avg,
    CAST(CASE WHEN t.valuenum_avg IS NULL OR st.mean IS NULL OR st.std IS NULL THEN NULL
              WHEN st.std = 0 AND t.valuenum_avg - st.mean = 0 THEN NULL
              WHEN st.std = 0 THEN sign(t.valuenum_avg - st.mean) * {LIMIT}
              ELSE greatest(-{LIMIT}, least({LIMIT}, round_even((t.valuenum_avg - st.mean) / st.std, 0))) END AS INTEGER) AS word
  FROM trail t LEFT JOIN st ON t.label = st.label),
onehot AS (SELECT DISTINCT subject_id, hours_in, label || '_' || CAST(word AS VARCHAR) AS feature
  FROM words WHERE word IS NOT NULL),
seqw AS (SELECT s.subject_id, s.step, s.hours_in, o.feature
  FROM slots s JOIN onehot o ON s.subject_id = o.subject_id AND s.src_hour = o.hours_in),
st_attr AS (
  SELECT subject_id, gender, {_band_sql('age', P['age_bands'], P['band_default'])} AS age,
         {_category_sql('ethnicity')} AS ethnicity,
         {_band_sql('los', P['los_bands'], P['band_default'])} AS los,
         coalesce(language, 'Missing') AS language, insurance, discharge_location,
         first_careunit, readmission_30_days
  FROM idx_full WHERE hospital_expire_flag IS DISTINCT FROM 1),
st_hot AS (
  {" UNION ALL ".join(f"SELECT subject_id, '{c}_' || CAST({c} AS VARCHAR) AS feature FROM st_attr WHERE {c} IS NOT NULL" for c in FE.STATIC_COLUMNS)}),
keep AS (SELECT DISTINCT w.subject_id FROM seqw w JOIN st_attr a ON w.subject_id = a.subject_id
         JOIN fvf f ON w.subject_id = f.subject_id),
flag_hot AS (
  {" UNION ALL ".join(f"SELECT subject_id, '{n}' AS feature FROM fvf WHERE {n} = 1" for n in q_flags.NAMES)}),
ftable AS (
  SELECT w.subject_id, w.step, w.feature FROM seqw w WHERE w.subject_id IN (SELECT subject_id FROM keep)
  UNION ALL
  SELECT subject_id, CAST(unnest(range(0, {N})) AS INTEGER) AS step, feature FROM (
    SELECT * FROM st_hot UNION ALL SELECT * FROM flag_hot) x
  WHERE subject_id IN (SELECT subject_id FROM keep))"""


def feature_sql(body: str) -> str:
    return S.with_roles("stays", "subjects", "visits", "deaths", "lab_events", "chart_events",
                        "item_dictionary", "code_dictionary", "code_facts", extra=FEATURE_CTES, body=body)


# ---- registered queries ----------------------------------------------------

@register("feature_stats", feature_sql("SELECT label, round(mean, 6) AS mean, round(std, 6) AS std FROM st"))
def feature_stats(spark, d):
    st = FE.feature_stats(fixture_trailing(Tables(spark, d)))
    return st.select("label", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@register("zscore_words", feature_sql("SELECT * FROM words"))
def zscore_words(spark, d):
    return fixture_words(Tables(spark, d))


@register("one_hot_words", feature_sql("SELECT * FROM onehot"))
def one_hot_words(spark, d):
    return FE.one_hot_words(fixture_words(Tables(spark, d)))


@register("sequence_words", feature_sql("SELECT * FROM seqw"))
def sequence_words(spark, d):
    return fixture_seq_words(Tables(spark, d))


@register("age_band", feature_sql(
    f"SELECT subject_id, age, {_band_sql('age', P['age_bands'], P['band_default'])} AS age_band FROM idx_full"))
def age_band(spark, d):
    s = fixture_index_stays(Tables(spark, d))
    return s.select("subject_id", "age", band("age", P["age_bands"], P["band_default"]).alias("age_band"))


@register("los_band", feature_sql(
    f"SELECT subject_id, los, {_band_sql('los', P['los_bands'], P['band_default'])} AS los_band FROM idx_full"))
def los_band(spark, d):
    s = fixture_index_stays(Tables(spark, d))
    return s.select("subject_id", "los", band("los", P["los_bands"], P["band_default"]).alias("los_band"))


@register("category_band", feature_sql(
    f"SELECT subject_id, ethnicity, {_category_sql('ethnicity')} AS category FROM idx_full"))
def category_band(spark, d):
    s = fixture_index_stays(Tables(spark, d))
    cat = category_by_substring(F.coalesce(F.col("ethnicity"), F.lit("")), P["ethnicity_rules"],
                                P["ethnicity_default"])
    return s.select("subject_id", "ethnicity", cat.alias("category"))


@register("static_attributes", feature_sql("SELECT * FROM st_attr"))
def static_attributes(spark, d):
    return fixture_static(Tables(spark, d))


@register("static_one_hot", feature_sql("SELECT * FROM st_hot"))
def static_one_hot(spark, d):
    return FE.static_one_hot(fixture_static(Tables(spark, d)))


@register("feature_table", feature_sql("SELECT * FROM ftable"))
def feature_table(spark, d):
    return fixture_table(Tables(spark, d))


@register("unit_report", feature_sql("""
SELECT first_careunit, CAST(sum(readmission_30_days) AS BIGINT) AS positives, count(*) AS subjects FROM (
  SELECT k.subject_id, max(a.first_careunit) AS first_careunit, max(a.readmission_30_days) AS readmission_30_days
  FROM (SELECT DISTINCT subject_id FROM ftable) k JOIN st_attr a ON k.subject_id = a.subject_id
  GROUP BY k.subject_id) GROUP BY first_careunit"""))
def unit_report(spark, d):
    t = Tables(spark, d)
    return FE.unit_report(fixture_table(t), fixture_static(t))


@register("feature_names", feature_sql("""
SELECT CAST(row_number() OVER (ORDER BY feature) AS INTEGER) AS feature_index, feature
FROM (SELECT DISTINCT feature FROM ftable)"""))
def feature_names(spark, d):
    return FE.feature_names(fixture_table(Tables(spark, d)))


@register("to_sequence", feature_sql("""
SELECT subject_id, step, list_sort(list(DISTINCT feature)) AS features FROM ftable GROUP BY subject_id, step"""))
def to_sequence(spark, d):
    return FE.to_sequence(fixture_table(Tables(spark, d)))
