"""Queries of build step 4: measurement series."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from wardlens.functions.codesets import FIXTURE, FIXTURE_EVENT_TYPES
from wardlens.operators import series
from wardlens.operators.ranking import row_number_within
from wardlens.plans import sqltext as S
from wardlens.plans.catalog import register
from wardlens.plans.q_cohort import fixture_index_stays, fixture_stays
from wardlens.sources import roles, sinks
from wardlens.sources.tables import Tables

P = FIXTURE
N = P["sequence_hours"]
LABELS = list(FIXTURE_EVENT_TYPES)


# ---- Spark side ----------------------------------------------------------

def fixture_cohort(t: Tables):
    """Index stays written once (D7) and re-read by the series and feature steps."""
    return t.derived("index_stays", lambda: fixture_index_stays(t, stays=fixture_stays(t)))


def fixture_measurements(t: Tables):
    cohort = fixture_cohort(t)
    dct = roles.item_dictionary(t.spark)
    return series.measurements(roles.lab_events(t), dct, P["lab_item_ids"],
                               roles.chart_events(t), dct, P["chart_item_ids"], cohort,
                               lab_keys=["subject_id"], chart_keys=["subject_id"])


def fixture_measurement_table(t: Tables):
    """D9 written once: the hour origin (an aggregate) and the join back both
    read it, so the raw fact tables are scanned once per branch, not twice."""
    return t.derived("measurements", lambda: fixture_measurements(t))


def fixture_hours(t: Tables):
    return series.with_hours(fixture_measurement_table(t))


def fixture_cells(t: Tables):
    return series.hourly_average(fixture_hours(t))


def fixture_trailing(t: Tables):
    """Trailing-window cells written once; statistics, words and slots re-read them."""
    return t.derived("trailing", lambda: series.trailing_window(fixture_cells(t), N))


# ---- oracle side ---------------------------------------------------------

def _branch(src: str, ids) -> str:
    return f"""SELECT a.subject_id, c.hadm_id, a.charttime, a.valuenum, CAST(a.charttime AS DATE) AS date_entered,
         b.label, b.itemid, c.icustay_id
  FROM {src} a LEFT JOIN item_dictionary b ON a.itemid = b.itemid
  JOIN idx_full c ON a.subject_id = c.subject_id
  WHERE b.itemid IN {S.in_list(ids)}"""


_UNITS = "CAST(round(valuenum * 1e10) AS HUGEINT)"


def _mean2(s: str, n: str) -> str:
    """round(avg, 2), ties away from zero, from an exact sum in units of 10^-10: only the average is rounded."""
    return (f"CASE WHEN {n} > 0 THEN CAST(sign({s}) AS DOUBLE) * CAST((2 * abs(CAST({s} AS HUGEINT)) + {n} * 100000000)"
            f" // ({n} * 200000000) AS DOUBLE) / 100.0 END")


SERIES_CTES = S.index_stays_cte() + f""",
meas AS (
  {_branch('lab_events', P['lab_item_ids'])}
  UNION ALL
  {_branch('chart_events', P['chart_item_ids'])}),
hrs AS (
  SELECT m.*, {S.round_ratio(S.minutes('m.charttime', 'o.min_time'), 60)} AS hours_in,
         CAST({S.minutes('m.charttime', 'o.min_time')} AS DOUBLE) / 60.0 AS hours_raw
  FROM meas m LEFT JOIN (SELECT subject_id, label, min(charttime) AS min_time FROM meas GROUP BY subject_id, label) o
    ON m.subject_id = o.subject_id AND m.label = o.label),
cells AS (
  SELECT subject_id, min(icustay_id) AS icustay_id, min(hadm_id) AS hadm_id, label, hours_in,
         {_mean2(f'sum({_UNITS})', f'count({_UNITS})')} AS valuenum_avg,
         count(*) AS n_measures
  FROM hrs GROUP BY subject_id, label, hours_in),
lasth AS (SELECT subject_id, max(hours_in) AS last_hour FROM cells WHERE valuenum_avg IS NOT NULL GROUP BY subject_id),
spanned AS (SELECT c.*, l.last_hour FROM cells c JOIN lasth l ON c.subject_id = l.subject_id
            WHERE c.valuenum_avg IS NOT NULL AND l.last_hour >= {N}),
trail AS (SELECT * FROM spanned WHERE hours_in >= last_hour - {N}),
grid AS (
  SELECT g.subject_id, g.hours_in, g.last_hour, coalesce(o.observed, false) AS observed
  FROM (SELECT subject_id, last_hour, unnest(range(last_hour - {N}, last_hour + 1)) AS hours_in
        FROM (SELECT DISTINCT subject_id, last_hour FROM trail)) g
  LEFT JOIN (SELECT DISTINCT subject_id, hours_in, true AS observed FROM trail) o
    ON g.subject_id = o.subject_id AND g.hours_in = o.hours_in),
filled AS (
  SELECT *, min(CASE WHEN observed THEN hours_in END) OVER (
      PARTITION BY subject_id ORDER BY hours_in ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS src_hour
  FROM grid),
slots AS (
  SELECT * EXCLUDE (rk), CAST({N} - rk AS INTEGER) AS step FROM (
    SELECT *, row_number() OVER (PARTITION BY subject_id ORDER BY hours_in DESC) AS rk FROM filled)
  WHERE rk <= {N})"""


def series_sql(body: str) -> str:
    return S.with_roles("stays", "subjects", "visits", "deaths", "lab_events", "chart_events",
                        "item_dictionary", extra=SERIES_CTES, body=body)


# ---- registered queries ----------------------------------------------------

@register("measurements", series_sql("SELECT * FROM meas"))
def measurements(spark, d):
    return fixture_measurements(Tables(spark, d))


@register("no_measurement_subjects", series_sql(
    "SELECT * FROM idx_full WHERE subject_id NOT IN (SELECT subject_id FROM meas)"))
def no_measurement_subjects(spark, d):
    t = Tables(spark, d)
    return series.no_measurement_subjects(fixture_cohort(t), fixture_measurements(t))


@register("hours_in", series_sql("SELECT * FROM hrs"))
def hours_in(spark, d):
    return fixture_hours(Tables(spark, d))


@register("hourly_average", series_sql("SELECT * FROM cells"))
def hourly_average(spark, d):
    return fixture_cells(Tables(spark, d))


@register("running_avg", series_sql(f"""
SELECT * EXCLUDE (units, s, n), {_mean2('s', 'n')} AS valuenum_running_avg FROM (
  SELECT *, sum(units) OVER w AS s, count(units) OVER w AS n
  FROM (SELECT *, {_UNITS} AS units FROM hrs)
  WINDOW w AS (PARTITION BY subject_id, label, hours_in ORDER BY itemid))"""))
def running_avg(spark, d):
    return series.running_average(fixture_hours(Tables(spark, d)))


_FINE = "SELECT * REPLACE (valuenum / 37 AS valuenum) FROM hrs"


@register("hourly_average_fine", series_sql(f"""
SELECT subject_id, min(icustay_id) AS icustay_id, min(hadm_id) AS hadm_id, label, hours_in,
       {_mean2(f'sum({_UNITS})', f'count({_UNITS})')} AS valuenum_avg, count(*) AS n_measures
FROM ({_FINE}) GROUP BY subject_id, label, hours_in"""))
def hourly_average_fine(spark, d):
    """T4 on values with many decimals: only the average is rounded."""
    return series.hourly_average(fixture_hours(Tables(spark, d)).withColumn("valuenum", F.col("valuenum") / 37))


@register("running_avg_fine", series_sql(f"""
SELECT * EXCLUDE (units, s, n), {_mean2('s', 'n')} AS valuenum_running_avg FROM (
  SELECT *, sum(units) OVER w AS s, count(units) OVER w AS n
  FROM (SELECT *, {_UNITS} AS units FROM ({_FINE}))
  WINDOW w AS (PARTITION BY subject_id, label, hours_in ORDER BY itemid))"""))
def running_avg_fine(spark, d):
    """W4 on values with many decimals."""
    return series.running_average(fixture_hours(Tables(spark, d)).withColumn("valuenum", F.col("valuenum") / 37))


@register("measurements_by_stay", series_sql("""
SELECT e.subject_id, c.hadm_id, e.charttime, e.valuenum, CAST(e.charttime AS DATE) AS date_entered, i.label, i.itemid, e.icustay_id
FROM (SELECT a.*, s.icustay_id, CASE WHEN a.event_id % 5 <> 0 THEN s.hadm_id END AS fact_hadm
      FROM chart_events a JOIN (SELECT subject_id, count(*) AS n FROM stays GROUP BY subject_id) k ON a.subject_id = k.subject_id
      JOIN (SELECT subject_id, hadm_id, icustay_id, row_number() OVER (PARTITION BY subject_id ORDER BY icustay_id) - 1 AS turn FROM stays) s
        ON a.subject_id = s.subject_id AND a.event_id % k.n = s.turn) e
JOIN item_dictionary i ON e.itemid = i.itemid
JOIN idx_full c ON e.subject_id = c.subject_id AND e.icustay_id = c.icustay_id
WHERE e.fact_hadm IS NOT NULL AND i.itemid IN """ + S.in_list(P["chart_item_ids"])))
def measurements_by_stay(spark, d):
    """J8 by (subject, stay) and P3: facts carry a stay id and a nullable visit id.

    The fixture's events have no stay; each gets exactly one stay of its subject, in turn by event id."""
    t = Tables(spark, d)
    st = fixture_stays(t).select("subject_id", "hadm_id", "icustay_id")
    turns = row_number_within(st, "subject_id", [F.col("icustay_id").asc_nulls_last()], "turn")
    counts = st.groupBy("subject_id").agg(F.count(F.lit(1)).alias("n_stays"))
    facts = roles.chart_events(t).join(counts, "subject_id").withColumn("turn", (F.pmod("event_id", "n_stays") + 1).cast("int"))
    facts = facts.join(turns, ["subject_id", "turn"]).drop("turn", "n_stays")
    facts = facts.withColumn("hadm_id", F.when(F.col("event_id") % 5 != 0, F.col("hadm_id")))
    return series.measurement_branch(facts, roles.item_dictionary(spark), P["chart_item_ids"], fixture_cohort(t),
                                     ["subject_id", "icustay_id"])


@register("sequence_summaries", series_sql("""
SELECT subject_id, label, n, CAST(y AS DOUBLE) / CAST(n AS DOUBLE) / 100 AS mean, last,
       CASE WHEN n * xx - x * x > 0 THEN CAST(n * xy - x * y AS DOUBLE) / CAST(n * xx - x * x AS DOUBLE) / 100 END AS slope
FROM (SELECT subject_id, label, count(*) AS n, max_by(valuenum_avg, hours_in) AS last, sum(h) AS x, sum(v) AS y, sum(h * v) AS xy, sum(h * h) AS xx
      FROM (SELECT *, CAST(hours_in AS HUGEINT) AS h, CAST(round(valuenum_avg * 100) AS HUGEINT) AS v FROM trail) GROUP BY subject_id, label)"""))
def sequence_summaries(spark, d):
    """M1: last, mean, slope and count of each label's hourly values."""
    return series.sequence_summaries(fixture_trailing(Tables(spark, d)))


@register("pivot_hourly", series_sql(
    "SELECT subject_id, icustay_id, hadm_id, hours_in, "
    + ", ".join(f"avg(CASE WHEN label = {S.q(lb)} THEN valuenum_avg END) AS {lb}" for lb in LABELS)
    + " FROM cells WHERE valuenum_avg IS NOT NULL GROUP BY subject_id, icustay_id, hadm_id, hours_in"))
def pivot_hourly(spark, d):
    return series.pivot_hourly(fixture_cells(Tables(spark, d)), LABELS)


@register("min_span", series_sql("SELECT * FROM spanned"))
def min_span(spark, d):
    return series.min_span(fixture_cells(Tables(spark, d)), N)


@register("trailing_window", series_sql("SELECT * FROM trail"))
def trailing_window(spark, d):
    return fixture_trailing(Tables(spark, d))


@register("regularize", series_sql("SELECT * FROM grid"))
def regularize(spark, d):
    return series.regularize(fixture_trailing(Tables(spark, d)), N)


@register("fill_backward", series_sql("SELECT * FROM filled"))
def fill_backward(spark, d):
    return series.fill_backward(series.regularize(fixture_trailing(Tables(spark, d)), N))


@register("clip_last", series_sql("SELECT * FROM slots"))
def clip_last(spark, d):
    return series.hourly_slots(fixture_trailing(Tables(spark, d)), N)


@register("last_step", series_sql(f"SELECT * FROM slots WHERE step = {N - 1}"))
def last_step(spark, d):
    return series.last_step(series.hourly_slots(fixture_trailing(Tables(spark, d)), N), N)


@register("stream_measurements", series_sql(f"SELECT * FROM ({_branch('lab_events', P['lab_item_ids'])})"))
def stream_measurements(spark, d):
    """Streaming refresh of the lab branch of D9 (rows-only check): every
    events file in the folder is processed once (``availableNow``) through a
    stream-static join to the written cohort, appended to a parquet table."""
    from wardlens.functions.codesets import FIXTURE_LAB_TYPES
    from wardlens.streaming.measurements import stream_measurements as start

    t = Tables(spark, d)
    base = sinks.scratch(spark, "streams")
    q = start(spark, d, t.events.schema, lambda ev: roles.event_facts(ev, FIXTURE_LAB_TYPES),
              roles.item_dictionary(spark), P["lab_item_ids"], fixture_cohort(t), ["subject_id"],
              os.path.join(base, "measurements"), checkpoint=os.path.join(base, "progress"),
              glob="events.parquet")
    q.awaitTermination()
    return spark.read.parquet(os.path.join(base, "measurements"))


@register("stream_hourly", series_sql(f"""
SELECT h.subject_id, min(h.icustay_id) AS icustay_id, min(h.hadm_id) AS hadm_id, h.label, h.hours_in,
       {_mean2(f'sum({_UNITS})', f'count({_UNITS})')} AS valuenum_avg, count(*) AS n_measures
FROM hrs h JOIN (SELECT subject_id, label, epoch_us(min(charttime)) AS origin FROM meas GROUP BY subject_id, label) o
  ON h.subject_id = o.subject_id AND h.label = o.label,
  (SELECT (epoch_us(max(charttime)) // 1000 - 3600000) * 1000 AS mark FROM meas) w
WHERE o.origin < w.mark AND o.origin + (60 * h.hours_in + 30) * 60000000 <= w.mark
GROUP BY h.subject_id, h.label, h.hours_in"""))
def stream_hourly(spark, d):
    """T4 on a stream that stops twice: the measurements of three spans of time arrive one after the other, and each
    time the query starts again from its checkpoint.  Its cells are those that the last watermark has closed."""
    from wardlens.streaming.hourly import stream_hourly as start

    t = Tables(spark, d)
    base = sinks.scratch(spark, "streams")
    meas, inbox = fixture_measurement_table(t), os.path.join(base, "inbox")
    at = F.unix_micros(F.col("charttime").cast("timestamp"))
    low, high = meas.agg(F.percentile_approx(at, [0.33, 0.66])).first()[0] or (0, 0)
    for part in (at <= low, (at > low) & (at <= high), at > high):
        meas.filter(part).write.mode("append").parquet(inbox)
        rows = spark.readStream.schema(meas.schema).parquet(inbox)
        start(rows, os.path.join(base, "cells"), os.path.join(base, "progress"), delay="1 hour").awaitTermination()
    return spark.read.parquet(os.path.join(base, "cells"))


@register("hours_in_subject_origin", series_sql(f"""
SELECT m.*, {S.round_ratio(S.minutes('m.charttime', 'o.min_time'), 60)} AS hours_in,
       CAST({S.minutes('m.charttime', 'o.min_time')} AS DOUBLE) / 60.0 AS hours_raw
FROM meas m LEFT JOIN (SELECT subject_id, min(charttime) AS min_time FROM meas GROUP BY subject_id) o
  ON m.subject_id = o.subject_id"""))
def hours_in_subject_origin(spark, d):
    """T1 with hour 0 at the subject's first measurement of any label (option for Q4)."""
    return series.with_hours(fixture_measurement_table(Tables(spark, d)), origin="subject")
