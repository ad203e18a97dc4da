"""Learning jobs re-aimed as distributed Spark ML (M1-M9).

The original trains recurrent networks on one machine.  Here:

* M1 embedding: each subject's sequence becomes token counts (how many steps
  carry each feature, and which features the last step carries) over the whole
  vocabulary of the training rows, scaled and projected on the leading right
  singular vectors (k = embedding size), which Spark finds by distributed
  matrix-vector products: an unsupervised low-dimension embedding;
* M2/M3 Gaussian mixture over all embedding components: all starts go through
  one pass over the data per EM step, the one with the highest log-likelihood
  is kept, every subject is assigned;
* M4-M6 classifiers: ``LogisticRegression`` — one global model, separate models
  per cohort (one fit whose weights are one block per cohort), and a multitask
  model with shared weights plus per-cohort interaction weights — and, as the
  non-linear family, boosted trees over tokens and cohort;
* S10: encoder and mixture are stored and read again as one clustering.

Per-subject inputs are bounded (hours x features per step), no feature is
dropped, and only model coefficients reach the driver.
"""

from __future__ import annotations

import os
from collections.abc import Sequence
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import (CountVectorizer, Interaction, OneHotEncoder, PCAModel, StandardScaler,
                                StringIndexer, VectorAssembler)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wardlens.operators.sampling import cohort_weights, hash8
from wardlens.sources.sinks import materialize, release

FEW_BLOCKS = 4             # blocks whose sums the mixture adds up on the driver
PART_ROWS = 2_000          # vectors worth a task of their own in the projection's products
FAN = 64                   # blocks whose sums one task adds up
ALL_TOKENS = 2 ** 31 - 1  # no feature is left out of a vocabulary


@contextmanager
def _persisted(df: DataFrame):
    """Keep a training set cached while a multi-stage fit scans it several
    times (each pipeline stage fits on it, then the optimizer iterates).
    Lost blocks are recomputed from lineage, which starts at written tables."""
    cached = df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield cached
    finally:
        cached.unpersist()


def _fit_inputs(train: DataFrame, *columns: str | None) -> DataFrame:
    """The columns that a fit reads, so that no other token list is kept for it."""
    return train.select(*dict.fromkeys(c for c in columns if c))


def sequence_tokens(table: DataFrame, hours: int, blocks: int = 4) -> DataFrame:
    """Per subject: ``tokens`` — one per (step, feature) plus ``last:feature``
    for the final step — and ``block_tokens`` — ``b{k}:feature`` for the k-th
    of ``blocks`` equal parts of the window, so the embedding keeps coarse
    time order.  Both lists are bounded by steps x features per step."""
    block = (F.col("step") * blocks / hours).cast("int").cast("string")
    tok = F.when(F.col("step") == hours - 1,
                 F.array(F.col("feature"), F.concat(F.lit("last:"), F.col("feature")))) \
        .otherwise(F.array(F.col("feature")))
    x = table.select("subject_id", tok.alias("_t"), F.concat(F.lit("b"), block, F.lit(":"), F.col("feature")).alias("_b"))
    return x.groupBy("subject_id").agg(F.flatten(F.collect_list("_t")).alias("tokens"),
                                       F.collect_list("_b").alias("block_tokens"))


def join_tokens(rows: DataFrame, other: DataFrame) -> DataFrame:
    """Rows that carry token lists joined to another table by subject, both sides dealt by subject.

    Written token lists take several hundred times their files' size in memory: a plan that goes by file sizes would
    take them for a small table and send them whole through the driver."""
    return rows.hint("merge").join(other, "subject_id")


def _embedding_input(df: DataFrame) -> DataFrame:
    out = df.withColumn("_emb_tokens", F.concat("tokens", "block_tokens"))
    return out.withColumn("_summary", array_to_vector("summary")) if "summary" in df.columns else out


def _token_counts(output: str, column: str = "tokens") -> CountVectorizer:
    return CountVectorizer(inputCol=column, outputCol=output, vocabSize=ALL_TOKENS, minDF=1.0)


def fit_embedding(train_tokens: DataFrame, k: int) -> PipelineModel:
    """M1: counts -> scaling -> projection on the ``k`` leading right singular
    vectors, over all tokens and time-block tokens of the training subjects and,
    if the rows have a ``summary`` array (``features.summary_vectors``), its numbers.

    The singular vectors come from distributed matrix-vector products; the
    driver holds vocabulary x k numbers, never a vocabulary x vocabulary matrix."""
    stages, wide = [_token_counts("_counts", "_emb_tokens")], "_counts"
    if "summary" in train_tokens.columns:
        wide = "_wide"
        stages.append(VectorAssembler(inputCols=["_counts", "_summary"], outputCol=wide))
    stages.append(StandardScaler(inputCol=wide, outputCol="_scaled", withMean=False, withStd=True))
    inputs = _embedding_input(train_tokens)
    with _persisted(_fit_inputs(inputs, "_emb_tokens", "_summary" if wide == "_wide" else None)) as train:
        head = Pipeline(stages=stages).fit(train)
        dims = head.stages[-1].std.size
        # every product of the iteration is a job over the vectors: they are kept, in parts of some PART_ROWS at least
        # (never more than the session's settings give them), and written before, as each of these jobs makes the
        # driver pack the whole lineage of what it reads
        vectors = materialize(head.transform(train).select("_scaled").coalesce(1 + train.count() // PART_ROWS), "scaled")
    with _persisted(MLUtils.convertVectorColumnsFromML(vectors, "_scaled")) as kept:
        svd = RowMatrix(kept).computeSVD(max(1, min(k, dims)), computeU=False)
    release(vectors)
    jvm = train_tokens.sparkSession._jvm
    axes = svd._java_model.V().asML()
    spread = jvm.org.apache.spark.ml.linalg.Vectors.zeros(axes.numCols()).toDense()
    project = PCAModel(jvm.org.apache.spark.ml.feature.PCAModel("projection", axes, spread))
    project.setInputCol("_scaled").setOutputCol("embedding").set(project.k, axes.numCols())
    return PipelineModel(stages=[*head.stages, project])


def embed(model: PipelineModel, tokens: DataFrame) -> DataFrame:
    """Apply the embedding to every subject: (subject_id, embedding vector)."""
    return model.transform(_embedding_input(tokens)).select("subject_id", "embedding")


@dataclass
class Mixture:
    """A fitted mixture: component weights, means and precision factors of standardised vectors."""

    center: np.ndarray
    scale: np.ndarray
    weight: np.ndarray    # (k,)
    mean: np.ndarray      # (k, d)
    root: np.ndarray      # (k, d, d): inverse of the covariance's Cholesky factor
    log_likelihood: float  # mean per row
    starts_run: int
    steps: int

    def log_density(self, z: np.ndarray) -> np.ndarray:
        """log(weight x density) of each component, rows x k."""
        return _log_density(z, self.weight, self.mean, self.root)


    def save(self, spark: SparkSession, path: str) -> None:
        """Store the parameters at ``path``: a table of one row per component."""
        whole = (self.center.tolist(), self.scale.tolist(), self.log_likelihood, self.starts_run, self.steps)
        rows = [(j, float(self.weight[j]), self.mean[j].tolist(), self.root[j].tolist(), *whole) for j in range(len(self.weight))]
        spark.createDataFrame(rows, MIXTURE_COLUMNS).coalesce(1).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "Mixture":
        """The mixture stored at ``path``; every number as it was."""
        rows = spark.read.parquet(path).orderBy("component").collect()  # one row per component
        r = rows[0]
        return cls(np.array(r["center"]), np.array(r["scale"]), *(np.array([x[c] for x in rows]) for c in ("weight", "mean", "root")),
                   r["log_likelihood"], r["starts_run"], r["steps"])


MIXTURE_COLUMNS = ("component int, weight double, mean array<double>, root array<array<double>>, center array<double>, scale array<double>, "
                   "log_likelihood double, starts_run int, steps int")


@dataclass
class Clustering:
    """Encoder and mixture, with the labels whose summaries the encoder reads, to store and to assign subjects
    that the fit has not seen."""

    encoder: PipelineModel
    mixture: Mixture
    labels: list[str]

    def assign(self, rows: DataFrame) -> DataFrame:
        """(subject_id, cluster, probability[]) of rows as the encoder was fitted on."""
        return assign_clusters(self.mixture, embed(self.encoder, rows))

    def save(self, spark: SparkSession, path: str) -> None:
        self.encoder.write().overwrite().save(os.path.join(path, "encoder"))
        self.mixture.save(spark, os.path.join(path, "mixture"))
        spark.createDataFrame(list(enumerate(self.labels)), "i int, label string").coalesce(1).write.mode("overwrite").parquet(os.path.join(path, "labels"))

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "Clustering":
        labels = [r["label"] for r in spark.read.parquet(os.path.join(path, "labels")).orderBy("i").collect()]  # one row per label
        return cls(PipelineModel.load(os.path.join(path, "encoder")), Mixture.load(spark, os.path.join(path, "mixture")), labels)


def _log_density(z: np.ndarray, weight: np.ndarray, mean: np.ndarray, root: np.ndarray) -> np.ndarray:
    out = np.empty((len(z), len(weight)))
    for j in range(len(weight)):
        y = (z - mean[j]) @ root[j].T
        out[:, j] = np.log(max(weight[j], 1e-300)) + np.log(np.abs(np.diag(root[j]))).sum() - 0.5 * (y * y).sum(1)
    return out - 0.5 * z.shape[1] * np.log(2 * np.pi)


def _log_sum(x: np.ndarray) -> np.ndarray:
    top = x.max(1, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(1, keepdims=True)))[:, 0]


def _parameters(n: np.ndarray, first: np.ndarray, second: np.ndarray, floor: float) -> tuple[np.ndarray, ...]:
    """M step: weights, means and precision factors from the sums of a start."""
    total = np.maximum(n, 1e-10)
    mean = first / total[:, None]
    cov = second / total[:, None, None] - mean[:, :, None] * mean[:, None, :]
    cov += floor * np.eye(first.shape[1])
    return n / n.sum(), mean, np.stack([np.linalg.inv(np.linalg.cholesky(_positive(c, floor))) for c in cov])


def _positive(cov: np.ndarray, floor: float) -> np.ndarray:
    """The nearest covariance without variances below ``floor``."""
    value, axis = np.linalg.eigh((cov + cov.T) / 2)
    return (axis * np.maximum(value, floor)) @ axis.T


def fit_mixture(embedded: DataFrame, k: int, starts: int, tol: float, seed: int = 0,
                features: str = "embedding", max_iter: int = 100, block_rows: int = 20_000,
                floor: float = 1e-6, groups: int | None = None) -> Mixture:
    """M2: the best of ``starts`` full-covariance Gaussian mixtures by
    log-likelihood, on all standardised components.

    Rows are packed once into blocks by a hash of the subject, sorted by subject
    inside, so sums are added in the same order whatever the session's
    partitioning, and the result is repeatable.  Each EM step is one pass over
    a grid of blocks x groups of starts for all starts that still move: a task
    returns the sums of its block for every start of its group (log densities,
    so nothing underflows), which are added up per start, in a tree where there
    are many blocks.  ``groups`` (default: enough for one task per core where
    blocks are few, else one) changes the speed only.  Start s takes as means the ``k`` subjects with the
    smallest hash of (seed + s, subject).  Ties go to the earlier start."""
    spark = embedded.sparkSession
    x = embedded.select("subject_id", vector_to_array(features).alias("v"))
    rows = x.count()
    blocks = max(1, -(-rows // block_rows))
    k = min(k, max(1, rows))
    if groups is None:
        groups = spark.sparkContext.defaultParallelism // blocks
    groups = max(1, min(groups, starts))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("subject_id", kind="stable")
        v = np.stack(pdf["v"].to_numpy())
        return pd.DataFrame({"block": [int(pdf["block"].iloc[0])], "n": [len(v)], "v": [v.tobytes()],
                             "s1": [v.sum(0).tolist()], "s2": [(v * v).sum(0).tolist()]})

    packed = materialize(x.withColumn("block", F.pmod(hash8(F.lit("block"), F.col("subject_id")), F.lit(blocks)).cast("int"))
                         .groupBy("block").applyInPandas(pack, "block int, n long, v binary, s1 array<double>, s2 array<double>"), "mixture-blocks")
    sums = packed.select("block", F.posexplode(F.arrays_zip("s1", "s2")).alias("i", "s")).groupBy("i").agg(
        F.array_sort(F.collect_list(F.struct("block", "s.s1", "s.s2"))).alias("s"))
    add = {r["i"]: (sum(t["s1"] for t in r["s"]), sum(t["s2"] for t in r["s"])) for r in sums.collect()}  # one row per component
    total = np.array([add[i] for i in range(len(add))])
    center = total[:, 0] / rows
    scale = np.sqrt(np.maximum(total[:, 1] / rows - center ** 2, 0))
    scale[scale < 1e-12] = 1.0
    d = len(center)

    # k rows per start: a bounded list
    first = x.select("v", "subject_id", F.explode(F.sequence(F.lit(seed), F.lit(seed + starts - 1))).alias("s"))
    by = Window.partitionBy("s").orderBy(hash8(F.col("s"), F.col("subject_id")), "subject_id")
    top = first.withColumn("n", F.row_number().over(by)).filter(F.col("n") <= k).select("s", "n", "v").collect()
    chosen = {s: np.array([r["v"] for r in sorted((r for r in top if r["s"] == seed + s), key=lambda r: r["n"])]) for s in range(starts)}
    state = {s: (np.full(k, 1 / k), (chosen[s] - center) / scale, np.stack([np.eye(d)] * k)) for s in range(starts)}
    best, done, steps = {}, {}, 0

    # a grid's cells are files of their own, so that few blocks still make many tasks
    grid = packed.select("v", "block", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"))
    grid = materialize(grid, "mixture-grid", partition_by=("block", "group")) if groups > 1 else grid

    while state and steps < max_iter:
        steps += 1
        sent = spark.sparkContext.broadcast((state, center, scale))

        def expect(batches):
            for pdf in batches:
                for block, group, raw in zip(pdf["block"], pdf["group"], pdf["v"]):
                    now, c, w = sent.value
                    z = (np.frombuffer(raw).reshape(-1, len(c)) - c) / w
                    for s in sorted(now)[group::groups]:
                        weight, mean, root = now[s]
                        log = _log_density(z, weight, mean, root)
                        norm = _log_sum(log)
                        r = np.exp(log - norm[:, None])
                        second = np.stack([(z * r[:, [j]]).T @ z for j in range(len(weight))])
                        stat = np.concatenate(([norm.sum()], r.sum(0), (r.T @ z).ravel(), second.ravel()))
                        yield pd.DataFrame({"s": [s], "block": [int(block)], "stat": [stat.tobytes()]})

        def add_up(pdf: pd.DataFrame) -> pd.DataFrame:
            total = np.zeros(1)
            for b in pdf.sort_values("block")["stat"]:
                total = total + np.frombuffer(b)
            return pd.DataFrame({"s": [int(pdf["s"].iloc[0])], "block": [int(pdf["block"].iloc[0]) // FAN], "stat": [total.tobytes()]})

        stats, left = grid.select("block", "group", "v").mapInPandas(expect, "s int, block int, stat binary"), blocks
        while left > FEW_BLOCKS:  # a tree: no task adds up more than FAN blocks of a start
            stats = stats.groupBy("s", F.expr(f"block div {FAN}")).applyInPandas(add_up, "s int, block int, stat binary")
            left = -(-left // FAN)
        got = {s: np.zeros(1) for s in state}
        for r in sorted(stats.select("s", "block", "stat").collect(), key=lambda r: (r["s"], r["block"])):  # at most FEW_BLOCKS rows a start
            got[r["s"]] = got[r["s"]] + np.frombuffer(r["stat"])
        sent.destroy()
        for s, stat in got.items():
            like = stat[0] / rows
            n, one, two = stat[1:1 + k], stat[1 + k:1 + k + k * d].reshape(k, d), stat[1 + k + k * d:].reshape(k, d, d)
            if s in best and like - best[s] < tol or steps == max_iter:
                done[s] = (like, state.pop(s))
            else:
                state[s] = _parameters(n, one, two, floor)
            best[s] = like
    for table in (packed, grid) if groups > 1 else (packed,):
        release(table)
    winner = max(done, key=lambda s: (done[s][0], -s))
    like, (weight, mean, root) = done[winner]
    return Mixture(center, scale, weight, mean, root, float(like), len(done), steps)


def mixture_log_likelihood(model: Mixture) -> float:
    """Mean log-likelihood per training row."""
    return model.log_likelihood


def assign_clusters(model: Mixture, embedded: DataFrame, features: str = "embedding") -> DataFrame:
    """M3: (subject_id, cluster, probability[]) for every subject."""
    sent = embedded.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for pdf in batches:
            m = sent.value
            if not len(pdf):
                continue
            log = m.log_density((np.stack(pdf["v"].to_numpy()) - m.center) / m.scale)
            p = np.exp(log - _log_sum(log)[:, None])
            yield pd.DataFrame({"subject_id": pdf["subject_id"], "cluster": p.argmax(1).astype("int32"), "probability": list(p)})

    x = embedded.select("subject_id", vector_to_array(features).alias("v"))
    return x.mapInPandas(run, f"subject_id {dict(x.dtypes)['subject_id']}, cluster int, probability array<double>")


def _lr(label: str, weight: str | None, features: str = "features", reg: float = 0.01) -> LogisticRegression:
    lr = LogisticRegression(featuresCol=features, labelCol=label, regParam=reg, elasticNetParam=0.0,
                            maxIter=100, probabilityCol="_prob")
    if weight:
        lr = lr.setWeightCol(weight)
    return lr


def _score(model: PipelineModel, rows: DataFrame, keep: Sequence[str]) -> DataFrame:
    out = model.transform(rows)
    return out.select(*keep, vector_to_array("_prob")[1].alias("score"))


def cohort_tasks(rows: DataFrame, cohort: str) -> DataFrame:
    """(task, cohort): the cohorts in sorted order, numbered from 0; one row per cohort."""
    names = rows.filter(F.col(cohort).isNotNull()).select(cohort).distinct()
    # a window over one row per cohort
    return names.select((F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(cohort)) - 1).alias("task"), cohort)


def fit_global(train: DataFrame, label: str, weight: str | None = None,
               cohort: str | None = None) -> PipelineModel:
    """M4: one classifier for all cohorts (optional row weights); with
    ``cohort`` its one-hot is appended to the features (F13)."""
    stages = [_token_counts("_tok" if cohort else "features")]
    if cohort:
        stages += [StringIndexer(inputCol=cohort, outputCol="_cidx", handleInvalid="keep"),
                   OneHotEncoder(inputCol="_cidx", outputCol="_conehot", dropLast=False),
                   VectorAssembler(inputCols=["_tok", "_conehot"], outputCol="features")]
    with _persisted(_fit_inputs(train, "tokens", label, weight, cohort)) as data:
        return Pipeline(stages=stages + [_lr(label, weight)]).fit(data)


def fit_separate(train: DataFrame, label: str, cohort: str, reg: float = 0.01) -> PipelineModel:
    """M5: one classifier per cohort, fitted side by side in one job.

    The features are one block per cohort (its intercept and its tokens), rows
    weigh n / n_cohort and the penalty is divided by the number of cohorts, so
    the objective is the sum of the cohorts' own ones.  A cohort of one class
    gets its (penalised) one-sided fit, one that training lacks scores 1/2: no
    row is left without a score."""
    index = StringIndexer(inputCol=cohort, outputCol="_cidx", handleInvalid="keep")
    with _persisted(_fit_inputs(cohort_weights(train, cohort), "tokens", label, "weight", cohort)) as data:
        indexed = index.fit(data)
        lr = _lr(label, "weight", reg=reg / max(1, len(indexed.labels))).setFitIntercept(False).setStandardization(False)
        stages = [_token_counts("_tok"), indexed, OneHotEncoder(inputCol="_cidx", outputCol="_conehot", dropLast=False),
                  Interaction(inputCols=["_conehot", "_tok"], outputCol="_blocks"),
                  VectorAssembler(inputCols=["_conehot", "_blocks"], outputCol="features"), lr]
        return Pipeline(stages=stages).fit(data)


def fit_multitask(train: DataFrame, label: str, cohort: str, weight: str | None = None) -> PipelineModel:
    """M6: shared weights + per-cohort weights (cohort one-hot x features)."""
    stages = [
        _token_counts("_shared"),
        StringIndexer(inputCol=cohort, outputCol="_cidx", handleInvalid="keep"),
        OneHotEncoder(inputCol="_cidx", outputCol="_conehot", dropLast=False),
        Interaction(inputCols=["_conehot", "_shared"], outputCol="_task"),
        VectorAssembler(inputCols=["_shared", "_conehot", "_task"], outputCol="features"),
        _lr(label, weight),
    ]
    with _persisted(_fit_inputs(train, "tokens", label, weight, cohort)) as data:
        return Pipeline(stages=stages).fit(data)


def fit_trees(train: DataFrame, label: str, weight: str | None = None, cohort: str | None = None,
              rounds: int = 10, depth: int = 3, seed: int = 0) -> PipelineModel:
    """M4, non-linear: boosted trees over token counts and, with ``cohort``, its one-hot.

    Trees are grown on all rows by distributed split statistics, optional row weights included; a cohort that
    training lacks and a row without one have a slot of their own."""
    stages = [_token_counts("_tok" if cohort else "features")]
    if cohort:
        stages += [StringIndexer(inputCol=cohort, outputCol="_cidx", handleInvalid="keep"),
                   OneHotEncoder(inputCol="_cidx", outputCol="_conehot", dropLast=False),
                   VectorAssembler(inputCols=["_tok", "_conehot"], outputCol="features")]
    trees = GBTClassifier(labelCol=label, maxIter=rounds, maxDepth=depth, seed=seed).setProbabilityCol("_prob")
    if weight:
        trees = trees.setWeightCol(weight)
    with _persisted(_fit_inputs(train, "tokens", label, weight, cohort)) as data:
        return Pipeline(stages=[*stages, trees]).fit(data)


def stationarity(model: PipelineModel, train: DataFrame, label: str, weight: str | None = None) -> np.ndarray:
    """Gradient of a fitted logistic model's objective over its training rows, one number per weight (in units of the
    standardised feature where the fit standardises), the intercept's last; near 0 where the fit has converged.

    The rows are summed up in one pass; only vectors as long as the weights reach the driver."""
    lr = model.stages[-1]
    rows = model.transform(train).withColumn("_w", F.col(weight) if weight else F.lit(1.0))
    residual = F.col("_w") * (vector_to_array("_prob")[1] - F.col(label))
    # the summarizer takes weights above 0 only: a residual is larger than minus its row's weight
    x, parts = lr.getFeaturesCol(), Summarizer.metrics("sum")
    shifted, plain, spread, total, error = rows.withColumn("_r", residual).agg(
        parts.summary(F.col(x), F.col("_r") + F.col("_w")), parts.summary(F.col(x), F.col("_w")),
        Summarizer.metrics("std").summary(F.col(x), F.col("_w")), F.sum("_w"), F.sum("_r")).first()
    std, coefficients = spread["std"].toArray(), lr.coefficients.toArray()
    slope = (shifted["sum"].toArray() - plain["sum"].toArray()) / total
    if lr.getStandardization():
        gradient = np.where(std > 0, slope / np.where(std > 0, std, 1) + lr.getRegParam() * coefficients * std, 0)
    else:
        gradient = slope + lr.getRegParam() * coefficients
    return np.append(gradient, error / total if lr.getFitIntercept() else 0.0)


def score_global(model: PipelineModel, rows: DataFrame, keep: Sequence[str]) -> DataFrame:
    """M7: (keep..., score) with score = P(y = 1), for every family's model."""
    return _score(model, rows, keep)
