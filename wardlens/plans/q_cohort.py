"""Queries of build steps 1-2: sources and the index-stay cohort."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardlens.functions.codesets import FIXTURE, only
from wardlens.functions.scalar import age_years, bucket_values
from wardlens.operators import cohort
from wardlens.plans import sqltext as S
from wardlens.plans.catalog import register
from wardlens.sources import roles
from wardlens.sources.tables import Tables

P = FIXTURE
_EXCL = " AND ".join(f"first_careunit <> {S.q(u)}" for u in P["excluded_units"])


def fixture_index_stays(t: Tables, keep_ties: bool = False, all_deaths: bool = False, stays=None):
    return cohort.index_stays(roles.stays(t) if stays is None else stays, roles.subjects(t), roles.visits(t),
                              roles.deaths(t), **only(cohort.index_stays, P) | {"keep_ties": keep_ties, "all_deaths": all_deaths})


def fixture_stays(t: Tables):
    """The fixture's stay table (orders + line-item counts), written once when
    several steps of one query read it."""
    return t.derived("stays", lambda: roles.stays(t))


@register("scan_events", S.with_roles("lab_events", "chart_events", body="""
SELECT * FROM lab_events UNION ALL SELECT * FROM chart_events"""))
def scan_events(spark, d):
    t = Tables(spark, d)
    return roles.lab_events(t).unionByName(roles.chart_events(t))


@register("first_exit", S.with_roles("stays", body=f"""
SELECT subject_id, min(outtime) AS first_disch FROM stays WHERE {_EXCL} GROUP BY subject_id"""))
def first_exit(spark, d):
    s = cohort.exclude_units(roles.stays(Tables(spark, d)), P["excluded_units"])
    return cohort.first_exit(s)


@register("stay_sequence", S.with_roles("stays", body=f"""
SELECT *, CAST(row_number() OVER (PARTITION BY subject_id ORDER BY outtime ASC NULLS LAST, hadm_id ASC NULLS LAST, icustay_id ASC NULLS LAST) AS INTEGER) AS events
FROM stays WHERE {_EXCL}"""))
def stay_sequence(spark, d):
    s = cohort.exclude_units(roles.stays(Tables(spark, d)), P["excluded_units"])
    return cohort.stay_sequence(s)


@register("nth_stay", S.with_roles("stays", body=f"""
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY subject_id ORDER BY outtime ASC NULLS LAST, hadm_id ASC NULLS LAST, icustay_id ASC NULLS LAST) AS INTEGER) AS events
FROM stays WHERE {_EXCL}) WHERE events = 2"""))
def nth_stay(spark, d):
    s = cohort.exclude_units(roles.stays(Tables(spark, d)), P["excluded_units"])
    return cohort.nth_stay(s, 2)


@register("days_since_exit", S.with_roles("stays", body=f"""
SELECT s.*, f.first_disch,
       CAST({S.minutes('s.intime', 'f.first_disch')} AS DOUBLE) / 1440.0 AS days_raw,
       {S.days('s.intime', 'f.first_disch')} AS days
FROM (SELECT * FROM stays WHERE {_EXCL}) s
LEFT JOIN (SELECT subject_id, min(outtime) AS first_disch FROM stays WHERE {_EXCL} GROUP BY subject_id) f
  ON s.subject_id = f.subject_id"""))
def days_since_exit(spark, d):
    s = cohort.exclude_units(roles.stays(Tables(spark, d)), P["excluded_units"])
    return cohort.days_since_exit(s)


@register("index_stay_argmin", S.with_roles("stays", body=f"""
SELECT s.*, f.first_disch FROM (SELECT * FROM stays WHERE {_EXCL}) s
JOIN (SELECT subject_id, min(outtime) AS first_disch FROM stays WHERE {_EXCL} GROUP BY subject_id) f
  ON s.subject_id = f.subject_id AND s.outtime = f.first_disch"""))
def index_stay_argmin(spark, d):
    s = cohort.exclude_units(roles.stays(Tables(spark, d)), P["excluded_units"])
    return cohort.index_stay_argmin(s)


@register("return_label", S.with_roles("stays", "subjects", "visits", "deaths",
                                       extra=S.index_stays_cte(), body="SELECT * FROM idx_full"))
def return_label(spark, d):
    return fixture_index_stays(Tables(spark, d))


@register("cohort_static", S.with_roles("stays", "subjects", "visits", "deaths",
                                        extra=S.index_stays_cte(keep_ties=True, all_deaths=True),
                                        body="SELECT * FROM idx_full"))
def cohort_static(spark, d):
    return fixture_index_stays(Tables(spark, d), keep_ties=True, all_deaths=True)


@register("location_bucket", S.with_roles("visits", body=f"""
SELECT subject_id, hadm_id, discharge_location AS raw_location,
       {S.bucket('discharge_location', P['discharge_buckets'], P['discharge_default'])} AS discharge_location
FROM visits"""))
def location_bucket(spark, d):
    v = roles.visits(Tables(spark, d))
    return v.select("subject_id", "hadm_id", F.col("discharge_location").alias("raw_location"),
                    bucket_values("discharge_location", P["discharge_buckets"], P["discharge_default"])
                    .alias("discharge_location"))


@register("age_filter", S.with_roles("stays", "subjects", body=f"""
SELECT * FROM (SELECT s.subject_id, s.hadm_id, {S.age('s.intime', 'b.dob')} AS age
FROM stays s JOIN subjects b ON s.subject_id = b.subject_id) WHERE age > {P['min_age_years']}"""))
def age_filter(spark, d):
    t = Tables(spark, d)
    s, b = roles.stays(t), roles.subjects(t)
    out = s.join(b, "subject_id").select("subject_id", "hadm_id",
                                         age_years("intime", "dob", P["year_days_milli"]).alias("age"))
    return out.filter(F.col("age") > P["min_age_years"])
