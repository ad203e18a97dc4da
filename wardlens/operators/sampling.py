"""Deterministic stratified split, bootstrap draws and weights.

Order within a class is a keyed hash ``hex8(md5(seed|id))`` with the id as
tie-break, so any engine can reproduce it.  Exact per-class ranks are built
without a window over a whole class: rows are spread over ``buckets`` hash
ranges, numbered inside their (class, bucket) only, and shifted by the
number of rows in lower buckets (a bounded table of class x bucket counts).
"""

from __future__ import annotations

from collections.abc import Sequence
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hash8(*parts: Column) -> Column:
    """First 8 hex digits of md5 over ``|``-joined parts, as a bigint in [0, 2^32)."""
    s = F.concat_ws("|", *[c.cast("string") for c in parts])
    return F.conv(F.substring(F.md5(s), 1, 8), 16, 10).cast("bigint")


def class_ranks(df: DataFrame, label: str, id_col: str, seed: int, buckets: int = 1024) -> DataFrame:
    """Add ``h`` (hash order key), ``rank`` (0-based position in the class by
    (h, id)) and ``n_class``.  No window spans more than one hash bucket."""
    h = hash8(F.lit(str(seed)), F.col(id_col))
    x = df.withColumn("h", h).withColumn("_b", (F.col("h") * buckets / F.lit(2 ** 32)).cast("int"))
    w = Window.partitionBy(label, "_b").orderBy("h", id_col)
    x = x.withColumn("_r", F.row_number().over(w) - 1)
    counts = x.groupBy(label, "_b").agg(F.count(F.lit(1)).alias("_nb"))
    wc = Window.partitionBy(label).orderBy("_b")
    offsets = counts.select(F.col(label).alias("_ol"), F.col("_b").alias("_ob"),
                            (F.sum("_nb").over(wc) - F.col("_nb")).alias("_off"),
                            F.sum("_nb").over(Window.partitionBy(label)).alias("n_class"))
    # offsets has at most (classes x buckets) rows: a bounded broadcast
    # rows without a label are a class of their own
    out = x.join(F.broadcast(offsets), F.col(label).eqNullSafe(F.col("_ol")) & (F.col("_b") == F.col("_ob")))
    return out.withColumn("rank", (F.col("_off") + F.col("_r")).cast("bigint")).drop("_b", "_r", "_off", "_ol", "_ob")


def _ceil_fraction(n: Column, fraction: float) -> Column:
    """ceil(n * fraction) on integers (fraction as a ratio a/b), so that
    0.2 * 15 is 3, not 4 as in binary floating point."""
    fr = Fraction(fraction).limit_denominator(1_000_000)
    return F.floor((n * fr.numerator + (fr.denominator - 1)) / F.lit(fr.denominator)).cast("bigint")


def stratified_split(df: DataFrame, label: str, id_col: str, seed: int = 0,
                     test_fraction: float = 0.2, validation_fraction: float = 0.125,
                     buckets: int = 1024) -> DataFrame:
    """Per class, the first ceil(test*n) rows in hash order are ``test``,
    the next ceil(val*(n - n_test)) ``val``, the rest ``train``."""
    r = class_ranks(df, label, id_col, seed, buckets)
    n_test = _ceil_fraction(F.col("n_class"), test_fraction)
    n_val = _ceil_fraction(F.col("n_class") - n_test, validation_fraction)
    split = F.when(F.col("rank") < n_test, "test").when(F.col("rank") < n_test + n_val, "val").otherwise("train")
    return r.withColumn("split", split).drop("h")


TASK_DRAWS = 500_000  # draws that one task makes, looks up or adds up, about


def _draw_tasks(ranked: DataFrame, replicates: int) -> int:
    """Tasks for every step over the draws, some ``TASK_DRAWS`` each: draws are few bytes, and a deal by bytes or into a
    fixed number of partitions would leave more of them to a task the more there are."""
    return 1 + ranked.count() * (replicates - 1) // TASK_DRAWS


def _positions(ranked: DataFrame, label: str, replicates: int, tasks: int | None = None) -> DataFrame:
    """(_dl: class, _k: rank, n_class, replicate) of every row in each replicate >= 1.

    A row of a few bytes becomes ``replicates`` - 1 ones: the rows are dealt by the draws they make."""
    tasks = tasks or _draw_tasks(ranked, replicates)
    rows = ranked.select(F.col(label).alias("_dl"), F.col("rank").alias("_k"), "n_class").repartition(tasks, "_k")
    return rows.select("*", F.explode(F.sequence(F.lit(1), F.lit(replicates - 1))).alias("replicate"))


def _place(label: str, rank: Column) -> Column:
    """A row's class and rank as one key: the draws are dealt by it once, for their counts and their lookup alike, and a
    NULL class is a class."""
    return F.struct(F.col(label).alias("class"), rank.cast("bigint").alias("rank"))


def _at_place(drawn: DataFrame, ranked: DataFrame, label: str, cols: Sequence[str]) -> DataFrame:
    """The row at each drawn ``_place``."""
    at = ranked.select(_place(label, F.col("rank")).alias("_row"), *cols)
    return drawn.hint("merge").join(at, F.col("_place") == F.col("_row"))


def _counted_draws(ranked: DataFrame, label: str, replicates: int, seed: int, tasks: int) -> DataFrame:
    """(replicate, _place, multiplicity) of every drawn row of each replicate >= 1."""
    drawn_rank = F.pmod(hash8(F.lit(str(seed)), F.col("replicate"), F.col("_dl"), F.col("_k")), F.col("n_class"))
    drawn = _positions(ranked, label, replicates, tasks).select("replicate", _place("_dl", drawn_rank).alias("_place"))
    return drawn.repartition(tasks, "_place").groupBy("replicate", "_place").agg(F.count(F.lit(1)).alias("multiplicity"))


def bootstrap_draws(df: DataFrame, label: str, id_col: str, replicates: int, seed: int = 0,
                    buckets: int = 1024) -> DataFrame:
    """R2: for replicate r >= 1, class c and position k < n_c the drawn row is
    the one at rank ``hex8(md5(seed|r|c|k)) mod n_c`` (with replacement, class
    sizes kept).  Replicate 0 is the original rows.

    Positions k are the ranks of the rows themselves, so the draw generation
    is spread like the data; each row fans out to ``replicates`` entries.
    Returns (replicate, label, k, id).
    """
    r = class_ranks(df.select(id_col, label), label, id_col, seed, buckets)
    original = r.select(F.lit(0).alias("replicate"), label, F.col("rank").alias("k"), id_col)
    if replicates <= 1:
        return original
    tasks = _draw_tasks(r, replicates)
    pos = _positions(r, label, replicates, tasks).withColumnsRenamed({"_dl": label, "_k": "k"})
    drawn_rank = F.pmod(hash8(F.lit(str(seed)), F.col("replicate"), F.col(label), F.col("k")), F.col("n_class"))
    pos = pos.select("replicate", label, "k", _place(label, drawn_rank).alias("_place")).repartition(tasks, "_place")
    drawn = _at_place(pos, r, label, [id_col]).select("replicate", label, "k", id_col)
    return original.unionByName(drawn)


def bootstrap_multiplicity(df: DataFrame, label: str, id_col: str, replicates: int, seed: int = 0,
                           buckets: int = 1024) -> DataFrame:
    """(replicate, id, multiplicity) for the same draws as ``bootstrap_draws``,
    counted before the id lookup: the draws are dealt by the row they draw, so
    repeats meet, are counted and are looked up in one task, and the result, dealt
    by id for the joins to come, holds distinct draws only (about 63 % of n per
    replicate)."""
    r = class_ranks(df.select(id_col, label), label, id_col, seed, buckets)
    original = r.select(F.lit(0).alias("replicate"), id_col, F.lit(1).cast("bigint").alias("multiplicity"))
    if replicates <= 1:
        return original
    tasks = _draw_tasks(r, replicates)
    drawn = _at_place(_counted_draws(r, label, replicates, seed, tasks), r, label, [id_col]).select("replicate", id_col, "multiplicity")
    # no fewer parts than a join would make by itself: it would deal the draws anew, and by bytes
    parts = max(tasks, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return original.unionByName(drawn).repartition(parts, id_col)


def bootstrap_scored(scored: DataFrame, label: str, id_col: str, replicates: int, seed: int = 0,
                     buckets: int = 1024) -> DataFrame:
    """The rows of ``scored`` of every replicate with ``replicate`` and ``multiplicity``: the draws of
    ``bootstrap_multiplicity``, looked up by (class, rank) in the ranked rows themselves, so no join
    on the id is needed."""
    r = class_ranks(scored, label, id_col, seed, buckets)
    cols = scored.columns
    original = r.select(F.lit(0).alias("replicate"), *cols, F.lit(1).cast("bigint").alias("multiplicity"))
    if replicates <= 1:
        return original
    counts = _counted_draws(r, label, replicates, seed, _draw_tasks(r, replicates))
    drawn = _at_place(counts, r, label, cols)
    return original.unionByName(drawn.select("replicate", *cols, "multiplicity"))


def draw_multiplicity(draws: DataFrame, id_col: str) -> DataFrame:
    """(replicate, id, multiplicity): how often each row is drawn."""
    return draws.groupBy("replicate", id_col).agg(F.count(F.lit(1)).alias("multiplicity"))


def bootstrap_sample(df: DataFrame, draws: DataFrame, id_col: str, replicate: int) -> DataFrame:
    """The rows of one replicate (drawn rows repeated); replicate 0 = df."""
    if replicate == 0:
        return df
    d = draws.filter(F.col("replicate") == replicate).select(id_col, "k")
    return df.join(d, id_col).drop("k")


def cohort_weights(train: DataFrame, cohort: str) -> DataFrame:
    """weight = n_train / n_in_cohort for each row.  The total comes from
    the per-cohort count table, so no window spans the data."""
    counts = train.groupBy(cohort).agg(F.count(F.lit(1)).alias("n_cohort"))
    counts = counts.withColumn("n_train", F.sum("n_cohort").over(Window.partitionBy(F.lit(0))))
    w = (F.col("n_train") / F.col("n_cohort")).alias("weight")
    counts = counts.select(F.col(cohort).alias("_wc"), "n_cohort", w)
    # one row per cohort, while the rows may hold far more than their files' size tells; rows without a cohort are one cohort
    return train.join(F.broadcast(counts), F.col(cohort).eqNullSafe(F.col("_wc"))).drop("_wc")


def task_weights(df: DataFrame, cohort: str, tasks: Sequence[str], weight: str | None = None) -> DataFrame:
    """One row per (row, task): weight x 1[cohort = task] (0 elsewhere)."""
    w = F.col(weight) if weight else F.lit(1.0)
    t = F.explode(F.array(*[F.lit(x) for x in tasks])).alias("task")
    out = df.select("*", t)
    return out.withColumn("task_weight", F.when(F.col(cohort) == F.col("task"), w).otherwise(F.lit(0.0)))
