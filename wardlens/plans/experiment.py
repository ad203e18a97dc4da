"""Experiment runner (M8, M9, S8-S10): pick the cohort column, fit one model
family, score the evaluation split, compute per-cohort / macro / micro AUC
(optionally bootstrapped) and write the rows to a run log, once per run, skipping
a configuration that the log already holds.
"""

from __future__ import annotations

import os
from dataclasses import dataclass, field

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlens.operators import evaluate as EV
from wardlens.operators import learn as L
from wardlens.operators import sampling as SA
from wardlens.sources import sinks


@dataclass
class ExperimentSpec:
    model: str = "GLOBAL"              # GLOBAL | SEPARATE | MULTITASK | TREES
    label: str = "readmission_30_days"
    cohort: str = "first_careunit"     # any cohort column, or "cluster" after with_cohorts
    sample_weights: bool = True        # cohort inverse-frequency weights (R4)
    cohort_as_feature: bool = False    # GLOBAL and TREES: append the cohort one-hot (F13)
    evaluate_on: str = "test"          # "val" (train mode) or "test" (test mode)
    replicates: int = 0                # 0: single AUC; >0: bootstrapped min/max/mean
    all_replicates: bool = False       # log every replicate's AUC instead of min/max/mean (E4)
    seed: int = 0
    run_id: str = "run"
    params: dict = field(default_factory=dict)

    def key(self) -> dict:
        return {"model": self.model, "cohort": self.cohort, "weights": str(self.sample_weights),
                "cohort_feature": str(self.cohort_as_feature),
                "split": self.evaluate_on, "replicates": str(self.replicates), "seed": str(self.seed),
                "all_replicates": str(self.all_replicates), **{k: str(v) for k, v in self.params.items()}}


def with_cohorts(rows: DataFrame, membership: DataFrame, name: str = "cluster") -> DataFrame:
    """Take cohorts from a cluster-membership table (joined on subject, as text)."""
    m = membership.select("subject_id", F.col("cluster").cast("string").alias(name))
    return L.join_tokens(rows, m)


FAMILIES = ("GLOBAL", "SEPARATE", "MULTITASK", "TREES")


def fit_family(spec: ExperimentSpec, train: DataFrame) -> PipelineModel:
    """M4-M6: the model of the specification's family on its training rows."""
    if spec.model == "SEPARATE":
        return L.fit_separate(train, spec.label, spec.cohort)
    weight = None
    if spec.sample_weights:
        train, weight = SA.cohort_weights(train, spec.cohort), "weight"
    if spec.model == "MULTITASK":
        return L.fit_multitask(train, spec.label, spec.cohort, weight)
    fit = L.fit_trees if spec.model == "TREES" else L.fit_global
    return fit(train, spec.label, weight, spec.cohort if spec.cohort_as_feature else None)


def _scored(spec: ExperimentSpec, rows: DataFrame, model_dir: str | None, load_dir: str | None = None) -> DataFrame:
    """Scores of the evaluation split, by a model fitted here (and saved) or, in test mode, by one saved earlier."""
    if spec.model not in FAMILIES:
        raise ValueError(f"unknown model family {spec.model}")
    name = spec.model.lower()
    if load_dir:
        model = PipelineModel.load(os.path.join(load_dir, name))
    else:
        model = fit_family(spec, rows.filter(F.col("split") == "train"))
        if model_dir:
            model.write().overwrite().save(os.path.join(model_dir, name))
    return L.score_global(model, rows.filter(F.col("split") == spec.evaluate_on), ["subject_id", spec.cohort, spec.label])


def evaluate_scores(spec: ExperimentSpec, scored: DataFrame) -> DataFrame:
    """(scope, metric, value): per-cohort, macro and micro AUC; bootstrapped
    min/max/mean of all three kinds of scope when ``replicates`` > 0."""
    y = scored.withColumnRenamed(spec.label, "y")
    base = EV.auc_macro_micro(y, spec.cohort).select("scope", F.lit("auc").alias("metric"),
                                                     F.col("auc").alias("value"))
    if spec.replicates <= 0:
        return base
    drawn = SA.bootstrap_scored(y, "y", "subject_id", spec.replicates, spec.seed)
    boot = EV.auc_bootstrap_macro_micro(drawn, spec.cohort, summary=not spec.all_replicates)
    if spec.all_replicates:
        return base.unionByName(boot.select(
            "scope", F.concat(F.lit("auc_rep_"), F.col("replicate").cast("string")).alias("metric"), F.col("auc").alias("value")))
    stacked = boot.select("scope", F.explode(F.array(
        *[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in ("auc_min", "auc_max", "auc_mean")]
    )).alias("m")).select("scope", "m.metric", "m.value")
    return base.unionByName(stacked)


def run_experiment(rows: DataFrame, spec: ExperimentSpec, log_path: str | None = None,
                   model_dir: str | None = None, allow_repeats: bool = False,
                   load_dir: str | None = None) -> DataFrame | None:
    """M9: run one configuration; returns its run-log rows (or None when the
    log already holds the configuration and repeats are not allowed).

    Train mode fits (and saves to ``model_dir``); test mode (``load_dir``)
    scores with the saved models instead of fitting."""
    spark = rows.sparkSession
    key = spec.key()
    found = sinks.read_log(spark, log_path) if log_path and not allow_repeats else None
    if found is not None:
        pm = F.from_json("params", "map<string,string>")
        log = found.select(*[pm[k].alias(k) for k in key]).distinct()
        cfg = spark.createDataFrame([tuple(key.values())], ", ".join(f"`{k}` string" for k in key))
        if sinks.pending_runs(cfg, log, list(key)).isEmpty():
            return None
    # scored once: every metric reads the written scores
    scored = sinks.materialize(_scored(spec, rows, model_dir, load_dir), "scored")
    metrics = evaluate_scores(spec, scored)
    out = metrics.select(F.lit(spec.run_id).alias("run_id"), sinks.params_json(key).alias("params"),
                         F.lit(spec.model).alias("model"), "scope", "metric",
                         F.col("value").cast("double").alias("value"))
    if log_path:
        sinks.log_results(out, log_path)
        sinks.release(scored)
        logged = sinks.read_log(spark, log_path)
        return logged.filter((F.col("run_id") == spec.run_id) & (F.col("params") == sinks.params_json(key)))
    return out
