"""End-to-end study over the clinical table set: the same chain the original
runs (cohort SQL -> hourly series -> words -> model table -> split ->
models -> bootstrapped AUC), written as one function per stage over any
tables that follow the clinical column contract (FIXTURES.md §1).

    tables = load_tables(spark, "/data/clinical")          # parquet by clinical name
    study = prepare(tables, CLINICAL)                        # written stage tables
    results = run_experiment(study.model_rows, ExperimentSpec(model="MULTITASK", replicates=100))

Intermediate tables (index stays, measurements, trailing cells, flags, model
rows) are written once under ``spark.checkpoint.dir`` and re-read, as the
original re-reads its materialized views.
"""

from __future__ import annotations

import os
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlens.functions.codesets import only
from wardlens.operators import cohort, features, flags, learn, sampling, series
from wardlens.sources.derived import DerivedTables
from wardlens.sources.sinks import materialize, release
from wardlens.sources.tables import JdbcSpec, read_table

# clinical table name for each role
CLINICAL_NAMES = {
    "stays": "icustays", "subjects": "patients", "visits": "admissions",
    "code_dictionary": "d_icd_diagnoses", "code_facts": "diagnoses_icd",
    "lab_events": "labevents", "lab_items": "d_labitems",
    "chart_events": "chartevents", "chart_items": "d_items",
}


@dataclass
class StudyTables:
    stays: DataFrame
    subjects: DataFrame
    visits: DataFrame
    code_dictionary: DataFrame
    code_facts: DataFrame
    lab_events: DataFrame
    lab_items: DataFrame
    chart_events: DataFrame
    chart_items: DataFrame
    deaths: DataFrame | None = None  # default: the visits table (deathtime, hospital_expire_flag)


@dataclass
class Study:
    index_stays: DataFrame
    flags: DataFrame
    measurements: DataFrame
    trailing: DataFrame
    sequence_words: DataFrame
    static: DataFrame
    model_table: DataFrame
    model_rows: DataFrame


def load_tables(spark: SparkSession, base: str | None = None, jdbc: dict[str, JdbcSpec] | None = None,
                names: dict[str, str] = CLINICAL_NAMES) -> StudyTables:
    """Read each role from ``{base}/{clinical name}`` (parquet) or from a JDBC spec per role."""
    def one(role: str) -> DataFrame:
        if jdbc and role in jdbc:
            return read_table(spark, jdbc[role])
        return spark.read.parquet(os.path.join(base, names[role]))
    return StudyTables(**{role: one(role) for role in names})


def prepare(t: StudyTables, params: dict, *, lab_keys=("subject_id",), chart_keys=("subject_id", "icustay_id"),
            seed: int = 0, keep_ties: bool = False) -> Study:
    """Run the data stages; every table that several later stages read is written once."""
    p = params
    hours = p["sequence_hours"]
    deaths = t.deaths if t.deaths is not None else t.visits
    stays = t.stays  # already a table: read where it stands
    with ThreadPoolExecutor(max_workers=1) as side:
        # the flags only share the stay table with the measurement chain: written side by side
        fl_future = side.submit(lambda: materialize(flags.first_visit_flags(
            stays, t.code_dictionary, t.code_facts, excluded_units=p["excluded_units"], code_flags=p["code_flags"],
            title_flag=p["title_flag"], lowercase_flags=p["lowercase_flags"],
            fact_side_flags=p.get("fact_side_flags", ("copd", "renal_failure"))), "flags"))
        idx = materialize(cohort.index_stays(stays, t.subjects, t.visits, deaths, **only(cohort.index_stays, p) | {"keep_ties": keep_ties}),
                          "index_stays")
        meas = materialize(series.measurements(t.lab_events, t.lab_items, p["lab_item_ids"],
                                               t.chart_events, t.chart_items, p["chart_item_ids"], idx,
                                               lab_keys=lab_keys, chart_keys=chart_keys), "measurements")
        cells = series.hourly_average(series.with_hours(meas))
        trail = materialize(series.trailing_window(cells, hours), "trailing")
        fl = fl_future.result()
    words = features.zscore_words(trail, features.feature_stats(trail), p["z_limit"])
    seq = features.sequence_words(series.hourly_slots(trail, hours), features.one_hot_words(words))
    static = features.static_attributes(idx, **only(features.static_attributes, p))
    names = list(p["code_flags"]) + ([p["title_flag"][0]] if p.get("title_flag") else [])
    table = features.feature_table(seq, static, fl, names, hours)
    # the split reads who has a row, written without the tokens: the tokens are collected once and dealt once
    who = materialize(features.table_subjects(table).join(static.select("subject_id", "readmission_30_days", "first_careunit").hint("merge"), "subject_id"),
                      "model_subjects")
    split = sampling.stratified_split(who.select("subject_id", "readmission_30_days"), "readmission_30_days",
                                      "subject_id", seed, p.get("test_fraction", 0.2),
                                      p.get("validation_fraction", 0.125))
    attributes = who.join(split.select("subject_id", "split").hint("merge"), "subject_id")
    model_rows = materialize(learn.join_tokens(learn.sequence_tokens(table, hours), attributes), "model_rows")
    release(who)
    return Study(idx, fl, meas, trail, seq, static, table, model_rows)


def study_graph(spark: SparkSession, root: str, t: StudyTables, versions: dict[str, str], params: dict, *,
                lab_keys=("subject_id",), chart_keys=("subject_id", "icustay_id")) -> DerivedTables:
    """S3: the study's four persisted tables (index stays, flags, measurements, hourly cells) as a graph that outlives the
    job: ``refresh`` rebuilds those that other parameters or other ``versions`` of the role tables touch."""
    p, g = params, DerivedTables(spark, root)
    deaths = t.deaths if t.deaths is not None else t.visits
    for role in (*CLINICAL_NAMES, "deaths"):
        g.source(role, lambda role=role: deaths if role == "deaths" else getattr(t, role), versions.get(role, versions["visits"]))
    g.table("index_stays", cohort.index_stays, ["stays", "subjects", "visits", "deaths"], only(cohort.index_stays, p))
    g.table("visit_flags", flags.first_visit_flags, ["stays", "code_dictionary", "code_facts"], {
        "fact_side_flags": p.get("fact_side_flags", ("copd", "renal_failure")),
        **{k: p[k] for k in ("excluded_units", "code_flags", "title_flag", "lowercase_flags")}})

    def measured(labs, lab_items, charts, chart_items, index, lab_ids, chart_ids):
        return series.measurements(labs, lab_items, lab_ids, charts, chart_items, chart_ids, index, lab_keys, chart_keys)

    g.table("measurements", measured, ["lab_events", "lab_items", "chart_events", "chart_items", "index_stays"],
            {"lab_ids": p["lab_item_ids"], "chart_ids": p["chart_item_ids"]})
    g.table("hourly", lambda m: series.hourly_average(series.with_hours(m)), ["measurements"])
    return g


def encoder_rows(study: Study, labels: list[str]) -> DataFrame:
    """M1: the model rows with the numeric summaries of the ``labels``' sequences beside the tokens."""
    return learn.join_tokens(study.model_rows, features.summary_vectors(series.sequence_summaries(study.trailing), labels))


def fit_clustering(study: Study, params: dict, seed: int = 0) -> learn.Clustering:
    """M1, M2: encoder and mixture fitted on the training subjects."""
    labels = sorted(r["label"] for r in study.trailing.select("label").distinct().collect())  # labels of the item dictionary
    rows = encoder_rows(study, labels)
    train = rows.filter(F.col("split") == "train")
    encoder = learn.fit_embedding(train, params["embedding_size"])
    emb = materialize(learn.embed(encoder, train), "embedding")
    mixture = learn.fit_mixture(emb, params["clusters"], params["cluster_starts"], params["cluster_tol"], seed)
    release(emb)
    return learn.Clustering(encoder, mixture, labels)


def cluster_cohorts(study: Study, params: dict, seed: int = 0, path: str | None = None, load: bool = False) -> DataFrame:
    """Every subject's cluster, by a clustering fitted on the training subjects (and stored at ``path``) or,
    with ``load``, by the one stored there earlier."""
    spark = study.model_rows.sparkSession
    if load:
        fitted = learn.Clustering.load(spark, path)
    else:
        fitted = fit_clustering(study, params, seed)
        if path:
            fitted.save(spark, path)
    return fitted.assign(encoder_rows(study, fitted.labels))
