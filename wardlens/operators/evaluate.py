"""ROC AUC per scope, bootstrapped, macro and micro.

AUC = (sum over positives of the average rank - P(P+1)/2) / (P*N), ties
sharing their average rank; NULL when a scope has one class only.  Computed
as sum over positives of (negatives with a lower score + half the tied
negatives): rows are first reduced to (scope, score) counts, cells, which are
written and counted; ``ranking.sum_before`` adds up the cells below each one
in ranges of some ``range_cells`` cells, so no window grows with the data,
also where one pooled scope has as many scores as rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlens.operators.ranking import sum_before


def _null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on equal keys, NULL equal to NULL; the keys of ``left`` stay."""
    names = {k: f"_k{i}" for i, k in enumerate(keys)}
    right = right.withColumnsRenamed(names)
    on = [F.col(k).eqNullSafe(F.col(n)) for k, n in names.items()]
    return left.join(right, on, how).drop(*names.values())


RANGE_CELLS = 500_000  # cells that one window task holds at most, about


def _cells_below(cells: DataFrame, keys: list[str], score: str, count: str, range_cells: int) -> DataFrame:
    """Add ``_below``: the sum of ``count`` over cells of the same scope with a strictly lower score."""
    return sum_before(cells, keys, score, count, "_below", range_cells)


def auc(scored: DataFrame, label: str = "y", score: str = "score", scopes: Sequence[str] = (),
        weight: str | None = None, range_cells: int = RANGE_CELLS) -> DataFrame:
    """One row per scope with ``auc``, ``n_pos`` and ``n_neg``.

    ``weight`` (e.g. bootstrap multiplicity) counts a row that many times;
    rows with a NULL score are ignored.
    """
    keys = list(scopes)
    return _auc_of_cells(_cells(scored, keys, label, score, weight), keys, score, range_cells)


def _cells(scored: DataFrame, keys: list[str], label: str, score: str, weight: str | None) -> DataFrame:
    """Positives and negatives by (scope, score)."""
    w = F.col(weight) if weight else F.lit(1)
    y = F.col(label)
    return scored.filter(F.col(score).isNotNull()).groupBy(*keys, score).agg(
        F.sum(F.when(y == 1, w).otherwise(0)).cast("double").alias("pos"),
        F.sum(F.when(y == 0, w).otherwise(0)).cast("double").alias("neg"))


def _auc_of_cells(cells: DataFrame, keys: list[str], score: str, range_cells: int) -> DataFrame:
    cells = _cells_below(cells, keys, score, "neg", range_cells)
    contrib = F.col("pos") * (F.col("_below") + F.col("neg") * 0.5)
    aggs = [F.sum(contrib).alias("_u"), F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg")]
    agg = cells.groupBy(*keys).agg(*aggs) if keys else cells.agg(*aggs)
    return agg.select(*keys, F.when((F.col("n_pos") > 0) & (F.col("n_neg") > 0),
                                    F.col("_u") / (F.col("n_pos") * F.col("n_neg"))).alias("auc"),
                      F.col("n_pos").cast("bigint").alias("n_pos"), F.col("n_neg").cast("bigint").alias("n_neg"))


def average_rank(df: DataFrame, score: str = "score", scopes: Sequence[str] = (), name: str = "avg_rank",
                 range_cells: int = RANGE_CELLS) -> DataFrame:
    """1-based rank of each row's score within its scope, ties sharing
    the average of their positions (``rank() + (ties - 1) / 2``); NULL scores
    get NULL.  Built on (scope, score) counts, so no window spans a scope."""
    keys = list(scopes)
    cells = df.filter(F.col(score).isNotNull()).groupBy(*keys, score) \
        .agg(F.count(F.lit(1)).cast("double").alias("_n"))
    cells = _cells_below(cells, keys, score, "_n", range_cells)
    ranks = cells.select(*keys, score, (F.col("_below") + (F.col("_n") + 1) / 2).alias(name))
    return _null_safe(df, ranks, keys + [score], "left")


def auc_by_cohort(scored: DataFrame, cohort: str, label: str = "y", score: str = "score", range_cells: int = RANGE_CELLS) -> DataFrame:
    """AUC per cohort (NULL for a one-class cohort; rows without a cohort are one cohort)."""
    return auc(scored, label, score, [cohort], range_cells=range_cells)


def auc_bootstrap(scored: DataFrame, draws: DataFrame, id_col: str, cohort: str, label: str = "y",
                  score: str = "score", summary: bool = True) -> DataFrame:
    """AUC per (replicate, cohort) over the drawn rows (multiplicities,
    not repeated rows); ``summary`` gives min / max / mean per cohort over
    the replicates whose AUC exists, else every replicate's AUC.

    ``draws`` is either (replicate, id, multiplicity) from
    ``sampling.bootstrap_multiplicity`` or one row per draw from
    ``sampling.bootstrap_draws``.  Scores do not depend on the replicate: the
    scored rows are joined to the multiplicities once.
    """
    if "multiplicity" in draws.columns:
        mult = draws.select("replicate", id_col, F.col("multiplicity").alias("_m"))
    else:
        mult = draws.groupBy("replicate", id_col).agg(F.count(F.lit(1)).alias("_m"))
    rows = scored.select(id_col, cohort, label, score).join(mult, id_col)
    per_rep = auc(rows, label, score, ["replicate", cohort], weight="_m")
    if not summary:
        return per_rep.select("replicate", cohort, "auc")
    ok = per_rep.filter(F.col("auc").isNotNull())
    return ok.groupBy(cohort).agg(F.min("auc").alias("auc_min"), F.max("auc").alias("auc_max"),
                                  F.avg("auc").alias("auc_mean"), F.count(F.lit(1)).alias("replicates"))


def auc_bootstrap_macro_micro(drawn: DataFrame, cohort: str, label: str = "y", score: str = "score",
                              weight: str = "multiplicity", summary: bool = True, range_cells: int = RANGE_CELLS) -> DataFrame:
    """E3-E6 together: the AUC of every cohort, their macro mean (missing ones
    ignored) and the pooled micro AUC, each per replicate; ``summary`` gives
    min / max / mean over the replicates whose AUC exists.

    ``drawn``: scored rows with ``replicate`` and ``weight`` (see
    ``sampling.bootstrap_scored``).  The rows are reduced once to (replicate,
    cohort, score) counts; the pooled scope sums those, not the rows."""
    cells = _cells(drawn, ["replicate", cohort], label, score, weight)
    pooled = cells.groupBy("replicate", score).agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    per = _auc_of_cells(cells, ["replicate", cohort], score, range_cells).select(
        "replicate", F.col(cohort).cast("string").alias("scope"), "auc")
    macro = per.groupBy("replicate").agg(F.avg("auc").alias("auc")).select("replicate", F.lit("macro").alias("scope"), "auc")
    micro = _auc_of_cells(pooled, ["replicate"], score, range_cells).select("replicate", F.lit("micro").alias("scope"), "auc")
    every = per.unionByName(macro).unionByName(micro)
    if not summary:
        return every
    return every.groupBy("scope").agg(F.min("auc").alias("auc_min"), F.max("auc").alias("auc_max"),
                                      F.avg("auc").alias("auc_mean"), F.count("auc").alias("replicates"))


def route_predictions(rows: DataFrame, predictions: DataFrame, id_col: str, cohort: str,
                      task: str = "task", score: str = "score") -> DataFrame:
    """Each row takes the prediction of its own cohort's head
    (``predictions`` is long: (id, task, score))."""
    p = predictions.select(id_col, F.col(task).alias(cohort), score)
    return rows.join(p, [id_col, cohort])


def auc_macro_micro(scored: DataFrame, cohort: str, label: str = "y", score: str = "score", range_cells: int = RANGE_CELLS) -> DataFrame:
    """Per-cohort AUCs, their macro mean (missing ones ignored) and the
    micro AUC over all rows pooled; ``scope`` names the row."""
    per = auc(scored, label, score, [cohort], range_cells=range_cells).select(F.col(cohort).cast("string").alias("scope"), "auc")
    macro = per.agg(F.avg("auc").alias("auc")).select(F.lit("macro").alias("scope"), "auc")
    micro = auc(scored, label, score, range_cells=range_cells).select(F.lit("micro").alias("scope"), "auc")
    return per.unionByName(macro).unionByName(micro)
