"""Feature words, static one-hot features and the model-ready table (A5, A6, A8-A10,
F1-F14, J12, J13, T10, T12).

Everything stays in long form ``(subject_id, step, feature)`` until the very
end: the schema never depends on the data, joins are on subject, and the
per-subject sequence is bounded by ``hours x features``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wardlens.functions.scalar import (band, bucket_values, category_by_substring, fill_missing,
                                      not_equal_keep_null, zscore_word)

STATIC_COLUMNS = ["gender", "age", "ethnicity", "los", "language", "insurance", "discharge_location"]


def feature_stats(trailing: DataFrame, value: str = "valuenum_avg") -> DataFrame:
    """A5/A6 per label: ``mean`` = mean over subjects of each subject's mean,
    ``std`` = pooled sample standard deviation (ddof 1).  Both are algebraic
    aggregates, so the shuffle carries partial sums only."""
    per_subject = trailing.groupBy("subject_id", "label").agg(F.avg(value).alias("_m"))
    means = per_subject.groupBy("label").agg(F.avg("_m").alias("mean"))
    stds = trailing.groupBy("label").agg(F.stddev_samp(value).alias("std"))
    return means.join(stds, "label", "full")


def zscore_words(trailing: DataFrame, stats: DataFrame, limit: int = 4,
                 value: str = "valuenum_avg") -> DataFrame:
    """word = clip(round_half_even((x - mean)/std), -limit, limit); NULL = missing.

    ``stats`` has one row per label of the label list, so broadcasting it is
    bounded by that list.
    """
    s = F.broadcast(stats.select("label", "mean", "std"))
    out = trailing.join(s, "label", "left")
    return out.select("subject_id", "hours_in", "label", value,
                      zscore_word(F.col(value), F.col("mean"), F.col("std"), limit).alias("word"))


def one_hot_words(words: DataFrame) -> DataFrame:
    """Indicator ``label_word`` per (subject, hour); the missing word
    emits nothing; several stays in one hour collapse (logical OR = distinct)."""
    return (words.filter(F.col("word").isNotNull())
            .select("subject_id", "hours_in",
                    F.concat_ws("_", F.col("label"), F.col("word").cast("string")).alias("feature"))
            .distinct())


def sequence_words(slots: DataFrame, onehot: DataFrame) -> DataFrame:
    """T8 completion: each slot takes every indicator of its source hour."""
    oh = onehot.withColumnRenamed("hours_in", "src_hour")
    return slots.select("subject_id", "step", "hours_in", "src_hour") \
        .join(oh.hint("merge"), ["subject_id", "src_hour"], "inner") \
        .select("subject_id", "step", "hours_in", "feature")


def static_attributes(index_stays: DataFrame, *, age_bands, los_bands, band_default: int,
                      ethnicity_rules, ethnicity_default: str, language_map=None) -> DataFrame:
    """F7-F11 + P13 + Q8: one row per subject with the banded attributes,
    label and cohort; rows flagged 1 in ``hospital_expire_flag`` are dropped
    (NULL kept)."""
    s = index_stays.filter(not_equal_keep_null("hospital_expire_flag", 1))
    lang = fill_missing("language")
    if language_map:
        known = [v for values in language_map.values() for v in values]
        lang = F.when(lang.isin(known), bucket_values(lang, language_map, "OTHER")).otherwise(lang)  # unmapped ones stay
    return s.select(
        "subject_id", "gender",
        band("age", age_bands, band_default).alias("age"),
        category_by_substring(F.coalesce(F.col("ethnicity"), F.lit("")), ethnicity_rules,
                              ethnicity_default).alias("ethnicity"),
        band("los", los_bands, band_default).alias("los"),
        lang.alias("language"), "insurance", "discharge_location",
        "first_careunit", "readmission_30_days")


def static_one_hot(static: DataFrame, columns: Sequence[str] = STATIC_COLUMNS) -> DataFrame:
    """long one-hot ``column_value`` per subject (NULL values emit nothing,
    as a dummy encoder does)."""
    arr = F.array(*[F.when(F.col(c).isNotNull(), F.concat_ws("_", F.lit(c), F.col(c).cast("string")))
                    for c in columns])
    return static.select("subject_id", F.explode(arr).alias("feature")).filter(F.col("feature").isNotNull())


def feature_table(seq_words: DataFrame, static: DataFrame, flags: DataFrame,
                  flag_names: Sequence[str], hours: int) -> DataFrame:
    """Long model table ``(subject_id, step, feature)``: the step's
    words, the subject's static indicators and its set flags at every step.

    Only subjects present in all three inputs are kept (inner merges).  The
    static/flag part is made once per subject and repeated over a bounded
    ``sequence(0, hours-1)``.  Every side grows with the subjects: all joins are
    by sort and merge, whatever the files' sizes.
    """
    keep = seq_words.select("subject_id").distinct() \
        .join(static.select("subject_id").hint("merge"), "subject_id") \
        .join(flags.select("subject_id").hint("merge"), "subject_id")
    flag_feats = flags.select("subject_id", F.explode(F.array(*[
        F.when(F.col(n) == 1, F.lit(n)) for n in flag_names])).alias("feature")) \
        .filter(F.col("feature").isNotNull())
    per_subject = static_one_hot(static).unionByName(flag_feats).join(keep.hint("merge"), "subject_id")
    repeated = per_subject.select("subject_id", F.explode(F.sequence(F.lit(0), F.lit(hours - 1))).alias("step"),
                                  "feature")
    words = seq_words.join(keep.hint("merge"), "subject_id").select("subject_id", "step", "feature")
    return words.unionByName(repeated)


def table_subjects(table: DataFrame) -> DataFrame:
    """(subject_id): the subjects of a model table, once each."""
    return table.select("subject_id").distinct()


SUMMARIES = ("n", "mean", "last", "slope")


def summary_vectors(summaries: DataFrame, labels: Sequence[str]) -> DataFrame:
    """M1: (subject_id, summary): ``series.sequence_summaries`` as one array per subject, the four numbers of each of
    ``labels`` in order; 0 for a label without values and for a slope that is NULL."""
    cells = [F.coalesce(F.max(F.when(F.col("label") == lb, F.col(c).cast("double"))), F.lit(0.0)) for lb in labels for c in SUMMARIES]
    return summaries.groupBy("subject_id").agg(F.array(*cells).alias("summary"))


def sequence_matrix(table: DataFrame, names: DataFrame, hours: int) -> DataFrame:
    """One compressed sparse-row matrix per subject, steps x features in the order of F14.

    ``indptr`` (hours + 1 numbers), ``indices`` (feature_index - 1, ascending within a step) and ``data`` (ones):
    the row of step s has the columns ``indices[indptr[s]:indptr[s + 1]]``.  A subject's cells are bounded by
    steps x features; repeated cells count once."""
    cells = table.join(names, "feature").select("subject_id", F.struct(F.col("step").cast("int").alias("step"), (F.col("feature_index") - 1).alias("at")).alias("c"))
    per = cells.groupBy("subject_id").agg(F.array_sort(F.collect_set("c")).alias("c"))
    steps = F.transform("c", lambda x: x["step"])
    return per.select("subject_id", F.transform(F.sequence(F.lit(0), F.lit(hours)), lambda s: F.size(F.filter(steps, lambda x: x < s))).alias("indptr"),
                      F.transform("c", lambda x: x["at"]).alias("indices"), F.transform("c", lambda x: F.lit(1)).alias("data"))


def matrix_cells(matrix: DataFrame, names: DataFrame) -> DataFrame:
    """The (subject_id, step, feature) rows that ``sequence_matrix`` packed."""
    rows = matrix.select("subject_id", "indptr", F.posexplode("indices").alias("i", "at"))
    step = F.size(F.filter("indptr", lambda p: p <= F.col("i"))) - 1
    return rows.select("subject_id", step.alias("step"), (F.col("at") + 1).alias("feature_index")).join(names, "feature_index") \
        .select("subject_id", "step", "feature")


def unit_report(table: DataFrame, static: DataFrame, unit: str = "first_careunit",
                label: str = "readmission_30_days") -> DataFrame:
    """Positives and subjects per cohort over the model table's subjects."""
    subj = table.select("subject_id").distinct().join(static.select("subject_id", unit, label).hint("merge"), "subject_id")
    per = subj.groupBy("subject_id").agg(F.max(unit).alias(unit), F.max(label).alias(label))
    return per.groupBy(unit).agg(F.sum(label).cast("bigint").alias("positives"),
                                 F.count(F.lit(1)).alias("subjects"))


def feature_names(table: DataFrame) -> DataFrame:
    """catalogue (feature_index, feature) of the features seen, by name.

    The distinct vocabulary is bounded (labels x words + static values +
    flags), so numbering it in one ordered window is cheap.
    """
    vocab = table.select("feature").distinct()
    return vocab.select(F.row_number().over(Window.orderBy("feature")).cast("int").alias("feature_index"),
                        "feature")


def to_sequence(table: DataFrame) -> DataFrame:
    """One row per (subject, step) with the sorted feature list of that step."""
    return table.groupBy("subject_id", "step").agg(F.array_sort(F.collect_set("feature")).alias("features"))
