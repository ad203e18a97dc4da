"""Queries of build step 8: embedding, mixture clustering and the three
classifier families.  Fits have no SQL restatement; their inputs, the row sets
they score and the invariants of the clustering do."""

from __future__ import annotations

import os

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Window
from pyspark.sql import functions as F

from wardlens.functions.codesets import CLINICAL
from wardlens.operators import evaluate as EV
from wardlens.operators import features as FE
from wardlens.operators import learn as L
from wardlens.operators import sampling as SA
from wardlens.operators import series
from wardlens.plans import experiment as X
from wardlens.plans.catalog import register
from wardlens.plans import sqltext as S
from wardlens.plans.q_eval import _ceil_frac, _h
from wardlens.plans.q_features import FEATURE_CTES, fixture_static, fixture_table
from wardlens.sources import sinks
from wardlens.plans.q_series import LABELS, N, fixture_trailing
from wardlens.sources.tables import Tables

SEED = 0
LABEL, COHORT = "readmission_30_days", "first_careunit"


def fixture_model_rows(t: Tables):
    """(subject_id, tokens, label, cohort, split), written once."""
    def build():
        table = fixture_table(t)
        st = fixture_static(t).select("subject_id", LABEL, COHORT)
        # the split reads who has a row, written without the tokens: the tokens are collected once and dealt once
        who = t.derived("model_subjects", lambda: FE.table_subjects(table).join(st.hint("merge"), "subject_id"))
        split = SA.stratified_split(who.select("subject_id", LABEL), LABEL, "subject_id", SEED,
                                    CLINICAL["test_fraction"], CLINICAL["validation_fraction"])
        return L.join_tokens(L.sequence_tokens(table, N), who.join(split.select("subject_id", "split").hint("merge"), "subject_id"))
    return t.derived("model_rows", build)


def _encoder_rows(t: Tables):
    """Model rows with the numeric summaries of their sequences beside the tokens, written once: the fit and the
    embedding both read them."""
    def build():
        vectors = FE.summary_vectors(series.sequence_summaries(fixture_trailing(t)), LABELS)
        return L.join_tokens(fixture_model_rows(t), vectors)
    return t.derived("encoder_rows", build)


def _encoder(t: Tables):
    return L.fit_embedding(_encoder_rows(t).filter(F.col("split") == "train"), CLINICAL["embedding_size"])


def _embedded(t: Tables):
    return L.embed(_encoder(t), _encoder_rows(t))


_SPLIT = "CASE WHEN rank < {t} THEN 'test' WHEN rank < {t} + {v} THEN 'val' ELSE 'train' END".format(
    t=_ceil_frac("n_class", 1, 5), v=_ceil_frac("n_class - " + _ceil_frac("n_class", 1, 5), 1, 8))
MODEL_CTES = FEATURE_CTES + f""",
mtok AS (SELECT subject_id, list_sort(list(token)) AS tokens FROM (
  SELECT subject_id, feature AS token FROM ftable
  UNION ALL SELECT subject_id, 'last:' || feature FROM ftable WHERE step = {N - 1}) GROUP BY subject_id),
mblock AS (SELECT subject_id, list_sort(list('b' || CAST((step * 4) // {N} AS VARCHAR) || ':' || feature)) AS block_tokens FROM ftable GROUP BY subject_id),
mrank AS (SELECT *, row_number() OVER (PARTITION BY {LABEL} ORDER BY h, subject_id) - 1 AS rank, count(*) OVER (PARTITION BY {LABEL}) AS n_class
  FROM (SELECT t.subject_id, t.tokens, b.block_tokens, a.{LABEL}, a.{COHORT}, {_h("'" + str(SEED) + "'", 't.subject_id')} AS h
        FROM mtok t JOIN mblock b USING (subject_id) JOIN st_attr a ON t.subject_id = a.subject_id)),
mrows AS (SELECT subject_id, tokens, block_tokens, {LABEL}, {COHORT}, {_SPLIT} AS split FROM mrank)"""


def learn_sql(body: str) -> str:
    return S.with_roles("stays", "subjects", "visits", "deaths", "lab_events", "chart_events", "item_dictionary",
                        "code_dictionary", "code_facts", extra=MODEL_CTES, body=body)


@register("model_rows", learn_sql("SELECT * FROM mrows"))
def model_rows(spark, d):
    """The rows of every model, tokens sorted, with label, cohort and split."""
    rows = fixture_model_rows(Tables(spark, d))
    return rows.select("subject_id", F.array_sort("tokens").alias("tokens"), F.array_sort("block_tokens").alias("block_tokens"),
                       LABEL, COHORT, "split")


@register("cohort_tasks", learn_sql(f"""
SELECT CAST(row_number() OVER (ORDER BY {COHORT}) - 1 AS INTEGER) AS task, {COHORT} FROM (SELECT DISTINCT {COHORT} FROM mrows WHERE {COHORT} IS NOT NULL)"""))
def cohort_tasks(spark, d):
    """The sorted task list, as the multitask family numbers its heads."""
    rows = fixture_model_rows(Tables(spark, d))
    return L.cohort_tasks(rows, COHORT)


@register("cohort_one_hot", learn_sql(f"SELECT subject_id, {COHORT} AS feature, 1 AS value FROM mrows WHERE {COHORT} IS NOT NULL"))
def cohort_one_hot(spark, d):
    """the cohort one-hot in long form."""
    rows = fixture_model_rows(Tables(spark, d))
    return rows.filter(F.col(COHORT).isNotNull()).select("subject_id", F.col(COHORT).alias("feature"), F.lit(1).alias("value"))


@register("separate_scored_scopes", learn_sql(f"""
SELECT family, coalesce({COHORT}, 'micro') AS scope, count(*) FILTER ({LABEL} = 1) AS n_pos, count(*) FILTER ({LABEL} = 0) AS n_neg
FROM mrows, (VALUES ('GLOBAL'), ('SEPARATE'), ('MULTITASK'), ('TREES')) f(family) WHERE split = 'test'
GROUP BY GROUPING SETS ((family, {COHORT}), (family))"""))
def separate_scored_scopes(spark, d):
    """M4-M7: rows that each family scores, by cohort and pooled; none may drop a row."""
    rows = fixture_model_rows(Tables(spark, d))
    train, test = rows.filter(F.col("split") == "train"), rows.filter(F.col("split") == "test")
    path, fits = sinks.scratch(spark, "models"), {}
    for family in X.FAMILIES:  # every family is saved and scores as reloaded
        X.fit_family(X.ExperimentSpec(model=family, label=LABEL, cohort=COHORT, cohort_as_feature=family == "TREES"), train) \
            .write().save(os.path.join(path, family))
        fits[family] = PipelineModel.load(os.path.join(path, family))
    out = None
    for family, model in fits.items():
        scored = L.score_global(model, test, ["subject_id", COHORT, LABEL]).filter(F.col("score").between(0, 1))
        n = [F.count(F.when(F.col(LABEL) == v, 1)).alias(c) for v, c in ((1, "n_pos"), (0, "n_neg"))]
        per = scored.groupBy(F.col(COHORT).alias("scope")).agg(*n)
        # the cohorts' counts added up: the rows are scored once
        part = per.unionByName(per.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_pos", "n_neg"))).withColumn("scope", F.lit("micro")))
        part = part.select(F.lit(family).alias("family"), "scope", "n_pos", "n_neg")
        out = part if out is None else out.unionByName(part)
    return out


@register("cluster_invariants", learn_sql("""
SELECT subject_id, 1 AS n_rows, true AS sums_to_one, true AS is_arg_max FROM mrows"""))
def cluster_invariants(spark, d):
    """M3: one row per subject, probabilities that sum to one, cluster = arg max."""
    m = _membership(Tables(spark, d))
    p = F.col("probability")
    return m.groupBy("subject_id").agg(
        F.count(F.lit(1)).cast("int").alias("n_rows"),
        F.bool_and(F.abs(F.aggregate(p, F.lit(0.0), lambda a, x: a + x) - 1) < 1e-9).alias("sums_to_one"),
        F.bool_and(F.get(p, F.col("cluster")) == F.array_max(p)).alias("is_arg_max"))


@register("sequences_read_back", learn_sql("""
SELECT f.subject_id, f.step, f.feature, n.feature_index FROM ftable f JOIN (
  SELECT CAST(row_number() OVER (ORDER BY feature) AS INTEGER) AS feature_index, feature FROM (SELECT DISTINCT feature FROM ftable)) n USING (feature)"""))
def sequences_read_back(spark, d):
    """Model table and feature names written and read again."""
    table = fixture_table(Tables(spark, d))
    path = sinks.scratch(spark, "sequences")
    sinks.write_sequences(table, FE.feature_names(table), path)
    names = spark.read.parquet(os.path.join(path, "feature_names"))
    return spark.read.parquet(os.path.join(path, "sequences")).join(names, "feature").select("subject_id", "step", "feature", "feature_index")


@register("membership_read_back", learn_sql(f"""
SELECT subject_id, CAST(subject_id % 4 AS VARCHAR) AS cluster, split FROM mrows"""))
def membership_read_back(spark, d):
    """A membership table is built once, read again, and replaces the cohort."""
    rows = fixture_model_rows(Tables(spark, d))
    path = sinks.scratch(spark, "membership")
    sinks.write_membership(rows.select("subject_id", (F.col("subject_id") % 4).alias("cluster")), path)

    def never():
        raise AssertionError("the written membership must be read")
    return X.with_cohorts(rows, sinks.load_or_build(spark, path, never)).select("subject_id", "cluster", "split")


@register("model_reload", learn_sql("SELECT subject_id, true AS same FROM mrows WHERE split = 'test'"))
def model_reload(spark, d):
    """A saved and reloaded model scores every row as before."""
    rows = fixture_model_rows(Tables(spark, d))
    test = rows.filter(F.col("split") == "test")
    m = L.fit_separate(rows.filter(F.col("split") == "train"), LABEL, COHORT)
    path = sinks.scratch(spark, "models")
    m.write().save(path)
    a, b = (L.score_global(x, test, ["subject_id"]) for x in (m, PipelineModel.load(path)))
    return a.join(b.withColumnRenamed("score", "again"), "subject_id").select("subject_id", (F.col("score") == F.col("again")).alias("same"))


@register("mixture_reload", learn_sql("SELECT subject_id, true AS same_embedding, true AS same_cluster, true AS same_probability FROM mrows"))
def mixture_reload(spark, d):
    """A stored clustering, read again, embeds and assigns every subject as the fitted one does."""
    t = Tables(spark, d)
    rows, encoder = _encoder_rows(t), _encoder(t)
    emb = t.derived("embedding", lambda: L.embed(encoder, rows))
    fitted = L.Clustering(encoder, _mixture(t, emb), LABELS)
    path = sinks.scratch(spark, "clusterings")
    fitted.save(spark, path)
    again = L.Clustering.load(spark, path)
    new = sinks.materialize(L.embed(again.encoder, rows), "embedding-again")
    both = [L.assign_clusters(m, e).hint("merge").join(e.select("subject_id", vector_to_array("embedding").alias("e")), "subject_id")
            .select("subject_id", F.struct("e", "cluster", "probability").alias(name)) for m, e, name in ((fitted.mixture, emb, "a"), (again.mixture, new, "b"))]
    x = both[0].hint("merge").join(both[1], "subject_id")
    return x.select("subject_id", *(F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")).alias(n) for c, n in (
        ("e", "same_embedding"), ("cluster", "same_cluster"), ("probability", "same_probability"))))


@register("sequence_matrix", learn_sql(f"""
SELECT subject_id, list(place ORDER BY step, place) AS indices, list(CAST(1 AS INTEGER)) AS data,
       list_transform(range(0, {N} + 1), lambda s: CAST(len(list_filter(list(step), lambda x: x < s)) AS INTEGER)) AS indptr
FROM (SELECT DISTINCT f.subject_id, f.step, n.place FROM ftable f JOIN (
  SELECT CAST(row_number() OVER (ORDER BY feature) - 1 AS INTEGER) AS place, feature FROM (SELECT DISTINCT feature FROM ftable)) n USING (feature))
GROUP BY subject_id"""))
def sequence_matrix(spark, d):
    """One sparse matrix per subject, written and read again."""
    table = fixture_table(Tables(spark, d))
    names, path = FE.feature_names(table), sinks.scratch(spark, "matrices")
    sinks.write_matrix(FE.sequence_matrix(table, names, N), names, path)
    return spark.read.parquet(os.path.join(path, "matrix"))


@register("clustered_sequences", learn_sql("""
SELECT subject_id, count(*) AS n_rows, CAST(1 AS BIGINT) AS n_files, true AS own_range, true AS sorted FROM ftable GROUP BY subject_id"""))
def clustered_sequences(spark, d):
    """The model table in files of disjoint subject ranges: each subject's rows, files, and whether its file's
    range overlaps no other and holds the subject's steps in order."""
    path = sinks.scratch(spark, "clustered")
    files = sinks.write_clustered(fixture_table(Tables(spark, d)), path)
    by = Window.partitionBy(F.lit(0)).orderBy("low", "high")  # one row per file
    files = files.select("file", (F.coalesce(F.lead("low").over(by) > F.col("high"), F.lit(True))
                                  & F.coalesce(F.lag("high").over(by) < F.col("low"), F.lit(True))).alias("own_range"))
    place = Window.partitionBy("subject_id", "file").orderBy("at")
    rows = spark.read.parquet(os.path.join(path, "rows")).select("subject_id", "step", F.col("_metadata.file_name").alias("file"), F.monotonically_increasing_id().alias("at"))
    rows = rows.withColumn("sorted", F.coalesce(F.lag("step").over(place) <= F.col("step"), F.lit(True)))
    return rows.join(files, "file").groupBy("subject_id").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct("file").alias("n_files"), F.bool_and("own_range").alias("own_range"), F.bool_and("sorted").alias("sorted"))


STATIONARY = 0.005  # largest gradient of a converged fit, per weight of a standardised feature


@register("model_stationary", learn_sql(f"""
SELECT family, CAST(CASE family WHEN 'GLOBAL' THEN v ELSE (c + 1) * (v + 1) + (CASE family WHEN 'MULTITASK' THEN v ELSE 0 END) END AS BIGINT) AS n_weights,
       true AS stationary
FROM (SELECT count(DISTINCT token) AS v FROM (SELECT unnest(tokens) AS token FROM mrows WHERE split = 'train')),
     (SELECT count(DISTINCT {COHORT}) AS c FROM mrows WHERE split = 'train'), (VALUES ('GLOBAL'), ('SEPARATE'), ('MULTITASK')) f(family)"""))
def model_stationary(spark, d):
    """M4-M6: each linear family's weights (one slot per cohort and one for cohorts that training lacks) and whether its
    objective stands still there, over all training rows."""
    rows, found = fixture_model_rows(Tables(spark, d)), []
    for family in ("GLOBAL", "SEPARATE", "MULTITASK"):
        train = _weighted_train(rows)
        model = X.fit_family(X.ExperimentSpec(model=family, label=LABEL, cohort=COHORT), rows.filter(F.col("split") == "train"))
        gradient = L.stationarity(model, train, LABEL, "weight")
        found.append((family, len(gradient) - 1, bool(abs(gradient).max() < STATIONARY)))
    return spark.createDataFrame(found, "family string, n_weights bigint, stationary boolean")


@register("embedding_invariants", learn_sql("SELECT subject_id, true AS contracted, true AS orthonormal FROM mrows"))
def embedding_invariants(spark, d):
    """M1: the axes are orthonormal, so no subject's embedding is longer than its scaled counts."""
    t = Tables(spark, d)
    encoder = _encoder(t)
    axes = encoder.stages[-1].pc.toArray()
    orthonormal = bool(abs(axes.T @ axes - np.eye(axes.shape[1])).max() < 1e-8)
    out = encoder.transform(L._embedding_input(_encoder_rows(t)))
    length = lambda c: F.aggregate(vector_to_array(c), F.lit(0.0), lambda a, x: a + x * x)
    return out.select("subject_id", (length("embedding") <= length("_scaled") * (1 + 1e-9)).alias("contracted"), F.lit(orthonormal).alias("orthonormal"))


@register("experiment_invariants", learn_sql(f"""
SELECT scope, true AS ordered, true AS macro_is_mean FROM (
  SELECT DISTINCT {COHORT} AS scope FROM mrows WHERE split = 'test' UNION ALL SELECT unnest(['macro', 'micro']))"""))
def experiment_invariants(spark, d):
    """Of each scope's bootstrapped AUCs the mean lies between least and greatest, and the macro AUC is the
    mean of the cohorts that have one."""
    spec = X.ExperimentSpec(model="GLOBAL", label=LABEL, cohort=COHORT, replicates=20, seed=SEED)
    rows = sinks.materialize(X.run_experiment(fixture_model_rows(Tables(spark, d)), spec), "experiment")
    wide = rows.groupBy("scope").pivot("metric", ["auc", "auc_min", "auc_mean", "auc_max"]).agg(F.first("value"))
    mean = rows.filter("metric = 'auc' AND scope NOT IN ('macro', 'micro')").agg(F.avg("value")).scalar()
    macro = rows.filter("metric = 'auc' AND scope = 'macro'").agg(F.max("value")).scalar()
    slack = 1e-12
    ordered = (F.col("auc_min") <= F.col("auc_mean") + slack) & (F.col("auc_mean") <= F.col("auc_max") + slack)
    return wide.select("scope", F.coalesce(ordered, F.lit(True)).alias("ordered"),
                       F.coalesce(F.abs(mean - macro) < 1e-9, F.lit(True)).alias("macro_is_mean"))


@register("embed_sequences")
def embed_sequences(spark, d):
    e = _embedded(Tables(spark, d))
    return e.select("subject_id", vector_to_array("embedding").alias("embedding"))


@register("cluster_fit_assign")
def cluster_fit_assign(spark, d):
    return _membership(Tables(spark, d))


def _weighted_train(rows):
    train = rows.filter(F.col("split") == "train")
    return SA.cohort_weights(train, COHORT)


def _test_auc(scored):
    return EV.auc_macro_micro(scored.withColumnRenamed(LABEL, "y"), COHORT)


def _mixture(t: Tables, emb):
    train = L.join_tokens(emb, fixture_model_rows(t).filter(F.col("split") == "train").select("subject_id"))
    return L.fit_mixture(train, CLINICAL["clusters"], CLINICAL["cluster_starts"], CLINICAL["cluster_tol"], SEED)


def _membership(t: Tables):
    emb = t.derived("embedding", lambda: _embedded(t))
    return L.assign_clusters(_mixture(t, emb), emb)


@register("model_global")
def model_global(spark, d):
    rows = fixture_model_rows(Tables(spark, d))
    m = L.fit_global(_weighted_train(rows), LABEL, weight="weight")
    test = rows.filter(F.col("split") == "test")
    return _test_auc(L.score_global(m, test, ["subject_id", COHORT, LABEL]))


@register("model_separate")
def model_separate(spark, d):
    rows = fixture_model_rows(Tables(spark, d))
    m = L.fit_separate(rows.filter(F.col("split") == "train"), LABEL, COHORT)
    test = rows.filter(F.col("split") == "test")
    return _test_auc(L.score_global(m, test, ["subject_id", COHORT, LABEL]))


@register("model_multitask")
def model_multitask(spark, d):
    rows = fixture_model_rows(Tables(spark, d))
    m = L.fit_multitask(_weighted_train(rows), LABEL, COHORT, weight="weight")
    test = rows.filter(F.col("split") == "test")
    return _test_auc(L.score_global(m, test, ["subject_id", COHORT, LABEL]))


@register("run_experiment")
def run_experiment(spark, d):
    """M9: multitask family, cohort weights, 100-replicate bootstrapped test AUC, logged."""
    t = Tables(spark, d)
    spec = X.ExperimentSpec(model="MULTITASK", label=LABEL, cohort=COHORT, replicates=CLINICAL["bootstrap_replicates"],
                            seed=SEED, run_id="multitask-0")
    log = sinks.scratch(spark, "runlog")
    return X.run_experiment(fixture_model_rows(t), spec, log_path=log)


@register("cluster_cohort_models")
def cluster_cohort_models(spark, d):
    """M8: cohorts from the mixture membership instead of the care unit."""
    t = Tables(spark, d)
    membership = t.derived("membership", lambda: _membership(t))
    # written once: the fit's jobs and the scoring read them
    rows = t.derived("cluster_rows", lambda: X.with_cohorts(fixture_model_rows(t), membership))
    spec = X.ExperimentSpec(model="GLOBAL", label=LABEL, cohort="cluster", seed=SEED, run_id="clusters-0")
    return X.run_experiment(rows, spec)
