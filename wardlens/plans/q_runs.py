"""Queries of build step 9: run log, configuration bookkeeping (S7-S9) and rebuilding of derived tables (S3)."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from wardlens.functions.codesets import FIXTURE
from wardlens.operators import evaluate as EV
from wardlens.plans import q_flags
from wardlens.plans import sqltext as S
from wardlens.plans.catalog import register
from wardlens.plans.q_eval import EVAL_CTES, _auc_sql, fixture_scored
from wardlens.plans.q_series import SERIES_CTES, _branch
from wardlens.plans.study import StudyTables, study_graph
from wardlens.sources import roles, sinks
from wardlens.sources.derived import DerivedTables, files_version
from wardlens.sources.tables import Tables

MODELS = ["GLOBAL", "SEPARATE", "MULTITASK"]


def _configs(t: Tables):
    """Every (model, cohort) pair: cohorts are the languages seen in documents."""
    langs = t.documents.select(F.col("lang").alias("scope")).distinct()
    return langs.select(F.explode(F.array(*[F.lit(m) for m in MODELS])).alias("model"), "scope")


def _log(t: Tables):
    """Run log holding the per-cohort AUCs of a GLOBAL run."""
    per = EV.auc_by_cohort(fixture_scored(t), "lang").withColumnRenamed("lang", "scope")
    return sinks.results_frame(t.spark, "run-0", {"reg": 0.01}, "GLOBAL", per)


@register("pending_runs", S.with_roles(extra=EVAL_CTES, body=f"""
SELECT c.model, c.scope FROM (
  SELECT m.model, l.scope FROM (SELECT DISTINCT lang AS scope FROM documents) l,
       (VALUES {", ".join(f"('{m}')" for m in MODELS)}) m(model)) c
WHERE NOT EXISTS (SELECT 1 FROM ({_auc_sql('scored', ['lang'])}) r WHERE c.model = 'GLOBAL' AND c.scope = r.lang)"""))
def pending_runs(spark, d):
    t = Tables(spark, d)
    return sinks.pending_runs(_configs(t), _log(t), ["model", "scope"])


@register("run_log_append", S.with_roles(extra=EVAL_CTES, body=f"""
SELECT r.run_id, r.params, 'GLOBAL' AS model, CAST(a.lang AS VARCHAR) AS scope, 'auc' AS metric, a.auc AS value
FROM ({_auc_sql('scored', ['lang'])}) a,
     (VALUES ('run-0', '{{"reg":"0.01"}}'), ('run-1', '{{"reg":"0.1"}}')) r(run_id, params)"""))
def run_log_append(spark, d):
    """Append two runs' rows to a fresh log folder and read the log back."""
    t = Tables(spark, d)
    path = sinks.scratch(spark, "runlog")
    per = EV.auc_by_cohort(fixture_scored(t), "lang").withColumnRenamed("lang", "scope")
    for run, reg in (("run-0", 0.01), ("run-1", 0.1)):
        sinks.append_results(sinks.results_frame(spark, run, {"reg": reg}, "GLOBAL", per), path)
    return spark.read.parquet(path)


@register("run_log_once", S.with_roles(extra=EVAL_CTES, body=f"""
SELECT r.run_id, r.params, 'GLOBAL' AS model, CAST(a.lang AS VARCHAR) AS scope, 'auc' AS metric, a.auc AS value
FROM ({_auc_sql('scored', ['lang'])}) a,
     (VALUES ('run-0', '{{"reg":"0.01"}}'), ('run-1', '{{"reg":"0.1"}}')) r(run_id, params)"""))
def run_log_once(spark, d):
    """Two runs logged at the same time, one of them again: one set of rows each."""
    t = Tables(spark, d)
    path = sinks.scratch(spark, "runlog")
    per = EV.auc_by_cohort(fixture_scored(t), "lang").withColumnRenamed("lang", "scope")
    first, second = (sinks.results_frame(spark, run, {"reg": reg}, "GLOBAL", per) for run, reg in (("run-0", 0.01), ("run-1", 0.1)))
    t.prefetch(lambda: sinks.log_results(first, path), lambda: sinks.log_results(second, path))
    sinks.log_results(first, path)
    return sinks.read_log(spark, path)


def fixture_graph(t: Tables, root: str) -> DerivedTables:
    """S3: the study's four persisted tables over the fixture's files, in dependency order."""
    files = {n: files_version(t.spark, os.path.join(t.sf_dir, f"{n}.parquet")) for n in ("orders", "lineitem", "customer", "part", "events")}
    made_of = {"stays": ("orders", "lineitem"), "subjects": ("customer",), "visits": ("orders",), "deaths": ("orders",), "code_dictionary": ("part",),
               "code_facts": ("lineitem", "orders"), "lab_events": ("events",), "chart_events": ("events",), "lab_items": (), "chart_items": ()}
    items = roles.item_dictionary(t.spark)
    tables = StudyTables(lab_items=items, chart_items=items, **{r: getattr(roles, r)(t) for r in made_of if not r.endswith("_items")})
    versions = {role: "+".join(files[n] for n in names) for role, names in made_of.items()}
    return study_graph(t.spark, root, tables, versions, FIXTURE, chart_keys=("subject_id",))


FEWER = list(FIXTURE["chart_item_ids"])[::2]


def _counts_sql(step: int, rebuilt: str, chart_ids) -> str:
    meas = f"SELECT * FROM ({_branch('lab_events', FIXTURE['lab_item_ids'])} UNION ALL {_branch('chart_events', chart_ids)})"
    hours = S.round_ratio(S.minutes("m.charttime", "o.min_time"), 60)
    hourly = f"""SELECT DISTINCT m.subject_id, m.label, {hours} AS h FROM ({meas}) m
      JOIN (SELECT subject_id, label, min(charttime) AS min_time FROM ({meas}) GROUP BY subject_id, label) o ON m.subject_id = o.subject_id AND m.label = o.label"""
    sizes = (("index_stays", "SELECT * FROM idx_full"), ("visit_flags", "SELECT * FROM first_st"), ("measurements", meas), ("hourly", hourly))
    return " UNION ALL ".join(f"SELECT {step} AS step, '{n}' AS name, {str(n in rebuilt.split()).lower()} AS rebuilt, count(*) AS n_rows FROM ({q})" for n, q in sizes)


@register("rebuild_cascade", S.with_roles(
    "stays", "subjects", "visits", "deaths", "lab_events", "chart_events", "item_dictionary", "code_dictionary", "code_facts",
    extra=SERIES_CTES + ",\n" + q_flags._FIRST_SQL, body=" UNION ALL ".join((
        _counts_sql(1, "index_stays visit_flags measurements hourly", FIXTURE["chart_item_ids"]), _counts_sql(2, "", FIXTURE["chart_item_ids"]),
        _counts_sql(3, "measurements hourly", FEWER), _counts_sql(4, "index_stays measurements hourly", FEWER)))))
def rebuild_cascade(spark, d):
    """S3: which tables are rebuilt, and their rows, (1) at first, (2) with nothing new, (3) after the list of chart items
    changed, (4) after the index stays were dropped with all that was built on them."""
    root = sinks.scratch(spark, "derived")
    g, found = fixture_graph(Tables(spark, d), root), []
    for step in (1, 2, 3, 4):
        if step == 3:
            g.change("measurements", chart_ids=FEWER)
        if step == 4:
            g.drop("index_stays")
        found += [(step, name, rebuilt, g.read(name).count()) for name, rebuilt in g.refresh().items()]
    for name in ("index_stays", "visit_flags"):
        g.drop(name)
    g.sweep()
    return spark.createDataFrame(found, "step int, name string, rebuilt boolean, n_rows bigint")
