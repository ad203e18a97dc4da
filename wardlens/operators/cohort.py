"""Index stay and return label (P1, P4-P7, A1, W1, W5, W6, J1-J5, T2; D7).

Plan shape at scale: the stays are shuffled once by ``subject_id``.  The
sequence window is always followed by ``rn <= 2`` / ``rn = n``, so Catalyst
inserts a partial WindowGroupLimit before the shuffle: a subject holding a
third of all stays still ships at most n rows per map task.  ``first_exit``
is a partial (map-side) aggregate.  Dimension joins are left to AQE, which
broadcasts a side only when its measured size is under the threshold.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wardlens.functions.scalar import age_years, bucket_values, open_interval_flag
from wardlens.functions.timecalc import days_since
from wardlens.operators.ranking import row_number_within

STAY_ORDER = ("outtime", "hadm_id", "icustay_id")  # stay id: total order for retries


def exclude_units(stays: DataFrame, units: Iterable[str], unit_col: str = "first_careunit") -> DataFrame:
    """Drop stays in the given units; a NULL unit is dropped too (SQL ``<>``)."""
    cond = None
    for u in units:
        c = F.col(unit_col) != F.lit(u)
        cond = c if cond is None else cond & c
    return stays if cond is None else stays.filter(cond)


def first_exit(stays: DataFrame, subject: str = "subject_id", end: str = "outtime") -> DataFrame:
    """A1: earliest end time per subject (``first_disch``)."""
    return stays.groupBy(subject).agg(F.min(end).alias("first_disch"))


def _seq_window(subject: str, order: tuple[str, ...]) -> Window:
    return Window.partitionBy(subject).orderBy(*[F.col(c).asc_nulls_last() for c in order])


def stay_sequence(stays: DataFrame, max_n: int | None = None, subject: str = "subject_id",
                  order: tuple[str, ...] = STAY_ORDER, name: str = "events") -> DataFrame:
    """Number each subject's stays by (end time, visit id), NULL end times last.

    With ``max_n`` only the first ``max_n`` stays are kept (top-n per group,
    W5), which lets Catalyst limit each group before the shuffle.  Without it
    every stay is numbered by ``ranking.row_number_within``: range partitions
    plus a bounded shift table, so a subject holding a large share of all
    stays is numbered across many tasks.
    """
    if max_n is None:
        return row_number_within(stays, subject, [F.col(c).asc_nulls_last() for c in order], name)
    out = stays.withColumn(name, F.row_number().over(_seq_window(subject, order)))
    return out.filter(F.col(name) <= max_n)


def nth_stay(stays: DataFrame, n: int, subject: str = "subject_id",
             order: tuple[str, ...] = STAY_ORDER) -> DataFrame:
    """The n-th stay of each subject (by end time, visit id)."""
    return stay_sequence(stays, n, subject, order).filter(F.col("events") == n)


def days_since_exit(stays: DataFrame, subject: str = "subject_id") -> DataFrame:
    """T2 + J1: every stay with days_raw/days from the subject's first exit."""
    fe = first_exit(stays, subject)
    out = stays.join(fe, subject, "left")
    raw, days = days_since("intime", "first_disch")
    return out.withColumn("days_raw", raw).withColumn("days", days)


def index_stay_argmin(stays: DataFrame, subject: str = "subject_id") -> DataFrame:
    """Stays whose end equals the subject's first exit (ties keep several rows)."""
    fe = first_exit(stays, subject)
    return stays.join(fe, (stays[subject] == fe[subject]) & (stays["outtime"] == fe["first_disch"])) \
        .drop(fe[subject])


def _index_rows(stays: DataFrame, keep_ties: bool) -> DataFrame:
    """Index stay(s) + first_disch + days to the second stay.

    Default: one pass over the subject-partitioned stays — the top-2 window,
    then ``lead`` over the same ordering gives the second stay's start (no
    self join, no second shuffle).  ``keep_ties``: the arg-min join (J3).
    """
    if keep_ties:
        seq = stay_sequence(stays, 2)
        second = seq.filter(F.col("events") == 2).select("subject_id", F.col("intime").alias("next_intime"))
        out = index_stay_argmin(stays).join(second, "subject_id", "left")
    else:
        seq = stay_sequence(stays, 2)
        nxt = F.lead("intime").over(_seq_window("subject_id", STAY_ORDER))
        out = (seq.withColumn("next_intime", nxt)
               .filter((F.col("events") == 1) & F.col("outtime").isNotNull())
               .drop("events").withColumn("first_disch", F.col("outtime")))
    _, days = days_since("next_intime", "first_disch")
    return out.withColumn("days_elapsed", days).drop("next_intime")


def latest_death(deaths: DataFrame) -> DataFrame:
    """Death records with a time and a flag other than 1; the latest per subject."""
    d = deaths.filter(F.col("deathtime").isNotNull() & (F.col("hospital_expire_flag") != 1))
    best = F.max(F.struct("deathtime", "hospital_expire_flag")).alias("d")
    return d.groupBy("subject_id").agg(best).select("subject_id", "d.deathtime", "d.hospital_expire_flag")


def index_stays(stays: DataFrame, subjects: DataFrame, visits: DataFrame, deaths: DataFrame,
                *, excluded_units: Iterable[str], discharge_buckets: Mapping[str, Iterable[str]],
                discharge_default: str = "OTHER", return_window_days: int = 30,
                min_age_years: float = 18, year_days_milli: int = 365242,
                keep_ties: bool = False, all_deaths: bool = False) -> DataFrame:
    """One index stay per subject with its return label.

    index stay = the stay with the earliest end (ties: lowest visit id, or all
    tied stays with ``keep_ties``); days = time from that end to the start of
    the second stay in the same order, rounded half away from zero; label =
    1 iff 0 < days < window.  Subjects are joined inner, visit attributes left
    on (subject, visit), death records left on subject (latest record per
    subject; ``all_deaths`` keeps every record and may repeat the stay).
    """
    s = exclude_units(stays, excluded_units)
    idx = _index_rows(s, keep_ties)
    subj = subjects.select("subject_id", "gender", "dob")
    vis = visits.select("subject_id", "hadm_id", "admittime",
                        bucket_values("discharge_location", discharge_buckets, discharge_default)
                        .alias("discharge_location"),
                        "language", "insurance", "ethnicity", "dischtime")
    if all_deaths:
        dth = deaths.filter(F.col("deathtime").isNotNull() & (F.col("hospital_expire_flag") != 1)) \
            .select("subject_id", "deathtime", "hospital_expire_flag")
    else:
        dth = latest_death(deaths)
    # both subject-keyed joins first (one partitioning by subject), then the
    # (subject, visit) join; the joins are on independent keys, so the order
    # does not change the rows; every side grows with the input, so none is
    # sent through the driver, however small its files are
    out = (idx.hint("merge").join(subj.hint("merge"), "subject_id", "inner")
           .join(dth.hint("merge"), "subject_id", "left")
           .join(vis.hint("merge"), ["subject_id", "hadm_id"], "left"))
    age = age_years("intime", "dob", year_days_milli)
    days = F.coalesce(F.col("days_elapsed"), F.lit(0)).cast("bigint")
    out = out.select(
        "subject_id", "hadm_id", "icustay_id", "first_careunit", "intime", "outtime", "los",
        "gender", "dob", "discharge_location", "language", "insurance", "ethnicity",
        "dischtime", "deathtime", "hospital_expire_flag",
        age.alias("age"),
        days.alias("days_since_discharge"),
        open_interval_flag(F.col("days_elapsed"), 0, return_window_days).alias("readmission_30_days"))
    return out.filter(F.col("age") > min_age_years)
