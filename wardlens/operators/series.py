"""Hourly measurement series.

Scale notes.  Every step is keyed by subject.  Where the original uses a
window over a subject's whole history (origin per label, last hour, running
mean) this module aggregates first (partial aggregation before the shuffle)
and joins the small per-key result back; AQE splits a hot subject's
partitions in those joins.  Windows are only used over bounded groups: the
N+1 hour slots of a subject, or the item ids of one (subject, label, hour)
cell.  Joins of two sides that grow with the input are hinted as sort-merge joins:
written tables take many times their files' size in memory, and a plan that goes
by file sizes would send them whole through the driver.  Values are summed as exact integers of 10^-10 and only the average is
rounded (half away from zero, 2 decimals), so sums do not depend on row order
and every engine agrees.  NaN and infinite values are NULL from ingest on; cells
with a value of 10^15 or more are averaged in double precision.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardlens.functions.timecalc import event_date, hours_since

MEASURE_COLS = ["subject_id", "hadm_id", "charttime", "valuenum", "date_entered", "label",
                "itemid", "icustay_id"]


def finite(value: Column) -> Column:
    """NULL for NaN and infinities."""
    return F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value)


EXACT = 1e15  # values below it are summed exactly; their units of 10^-10 keep 13 digits for the count


def _units(value: Column) -> Column:
    """The value in units of 10^-10, an exact integer; NULL at and beyond ``EXACT``."""
    return F.when(F.abs(finite(value)) < EXACT, F.round(value * F.lit(1e10)).cast("decimal(25,0)"))


def _large(value: Column) -> Column:
    """Values at and beyond ``EXACT`` as they are: cells that hold one are averaged in double precision,
    where neighbouring values lie further apart than the two decimals kept."""
    return F.when(F.abs(finite(value)) >= EXACT, value)


def _mean2(total: str, n: str, large: str, n_large: str) -> Column:
    """Mean of ``n`` values that sum to ``total`` units and ``n_large`` that sum to ``large``; without large ones
    rounded half away from zero to 2 decimals by integer division; NULL without values."""
    return F.expr(f"CASE WHEN {n_large} > 0 THEN ({large} + coalesce({total}, 0) / 1e10D) / ({n} + {n_large}) WHEN {n} > 0 THEN signum({total}) * "
                  f"((abs({total}) * 2 + {n} * 100000000) div ({n} * 200000000)) / 100.0D END")


# --------------------------------------------------------------------------
# measurement table
# --------------------------------------------------------------------------

def select_items(facts: DataFrame, item_ids: Iterable[int], item: str = "itemid") -> DataFrame:
    """Keep facts whose item id is in the list (pushed to the scan)."""
    return facts.filter(F.col(item).isin(list(item_ids)))


def measurement_branch(facts: DataFrame, dictionary: DataFrame, item_ids: Sequence[int],
                       cohort: DataFrame, join_keys: Sequence[str]) -> DataFrame:
    """One branch of D9: facts of the listed items, labelled through the
    dictionary (J6, written inner), restricted to the cohort (J8).

    The dictionary is broadcast after filtering it to ``item_ids``: its size is
    bounded by the length of that list; the cohort grows with the input and is
    joined by sort and merge.  Visit/stay columns missing from the facts are
    taken from the cohort row.
    """
    f = select_items(facts, item_ids)
    if "hadm_id" in f.columns:
        f = f.filter(F.col("hadm_id").isNotNull())  # P3
    d = F.broadcast(select_items(dictionary, item_ids).select("itemid", "label"))
    from_cohort = [c for c in ("hadm_id", "icustay_id") if c not in f.columns and c not in join_keys]
    c = cohort.select(*join_keys, *from_cohort)
    out = f.join(d, "itemid").join(c.hint("merge"), list(join_keys))
    return out.withColumn("date_entered", event_date("charttime")) \
        .withColumn("valuenum", finite(F.col("valuenum").cast("double"))).select(*MEASURE_COLS)


def measurements(labs: DataFrame, lab_dictionary: DataFrame, lab_ids: Sequence[int],
                 charts: DataFrame, chart_dictionary: DataFrame, chart_ids: Sequence[int],
                 cohort: DataFrame, lab_keys: Sequence[str] = ("subject_id",),
                 chart_keys: Sequence[str] = ("subject_id", "icustay_id")) -> DataFrame:
    """UNION ALL of the lab and chart branches (U1, by name)."""
    return measurement_branch(labs, lab_dictionary, lab_ids, cohort, lab_keys).unionByName(
        measurement_branch(charts, chart_dictionary, chart_ids, cohort, chart_keys))


def no_measurement_subjects(cohort: DataFrame, measured: DataFrame, key: str = "subject_id") -> DataFrame:
    """``cohort WHERE key NOT IN (SELECT key FROM measured)``, null-aware.

    Written as a shuffle anti join (scales with both sides) plus two scalar
    guards: any NULL key in ``measured`` empties the result, and a NULL
    cohort key survives only when ``measured`` is empty.
    """
    m = measured.select(key)
    # two scalar subqueries over the key column (partial aggregates, run once)
    has_null = m.select(F.max(F.col(key).isNull().cast("int"))).scalar()
    n_measured = m.select(F.count(F.lit(1))).scalar()
    keyed = cohort.filter(F.col(key).isNotNull()).join(m.filter(F.col(key).isNotNull()).distinct(),
                                                       key, "left_anti")
    null_keyed = cohort.filter(F.col(key).isNull() & (n_measured == 0))
    return keyed.unionByName(null_keyed).filter(F.coalesce(has_null, F.lit(0)) == 0)


# --------------------------------------------------------------------------
# hours and hourly cells
# --------------------------------------------------------------------------

def with_hours(meas: DataFrame, origin: str = "label") -> DataFrame:
    """Hours since the first measurement of the subject's label
    (``origin='label'``) or of the subject (``origin='subject'``)."""
    keys = ["subject_id", "label"] if origin == "label" else ["subject_id"]
    first = meas.groupBy(*keys).agg(F.min("charttime").alias("min_time"))
    out = meas.join(first.hint("merge"), keys, "left")
    raw, rounded = hours_since("charttime", "min_time")
    return out.withColumn("hours_in", rounded).withColumn("hours_raw", raw).drop("min_time")


def hourly_average(hours: DataFrame) -> DataFrame:
    """T4: one row per (subject, label, hour): mean value to 2 decimals.

    The visit/stay ids of a cell are its smallest ones (the original keeps an
    arbitrary row).
    """
    c, big = _units(F.col("valuenum")), _large(F.col("valuenum"))
    return (hours.groupBy("subject_id", "label", "hours_in")
            .agg(F.min("icustay_id").alias("icustay_id"), F.min("hadm_id").alias("hadm_id"),
                 F.sum(c).alias("_s"), F.count(c).alias("_n"), F.sum(big).alias("_b"), F.count(big).alias("_nb"),
                 F.count(F.lit(1)).alias("n_measures"))
            .select("subject_id", "icustay_id", "hadm_id", "label", "hours_in",
                    _mean2("_s", "_n", "_b", "_nb").alias("valuenum_avg"), "n_measures"))


def running_average(hours: DataFrame) -> DataFrame:
    """``avg(value) OVER (PARTITION BY subject, label, hour ORDER BY itemid)``
    with the default RANGE frame (rows of the same item are peers).

    Computed on per-item sums, so the window sees one row per item id of a
    cell, then joined back to the measurements.
    """
    keys = ["subject_id", "label", "hours_in"]
    c, big = _units(F.col("valuenum")), _large(F.col("valuenum"))
    per_item = hours.groupBy(*keys, "itemid").agg(F.sum(c).alias("_s"), F.count(c).alias("_n"), F.sum(big).alias("_b"), F.count(big).alias("_nb"))
    w = Window.partitionBy(*keys).orderBy(F.col("itemid").asc_nulls_last()) \
        .rangeBetween(Window.unboundedPreceding, Window.currentRow)
    run = per_item.select(*keys, "itemid", *(F.sum(x).over(w).alias(x) for x in ("_s", "_n", "_b", "_nb"))) \
        .select(*keys, "itemid", _mean2("_s", "_n", "_b", "_nb").alias("valuenum_running_avg"))
    return hours.join(run, keys + ["itemid"], "left")


def sequence_summaries(trailing: DataFrame) -> DataFrame:
    """M1 (per-feature summaries): (subject_id, label, n, mean, last, slope) of each label's hourly values.

    ``last`` is the value of the latest hour, ``slope`` the least-squares slope per hour, NULL where all values
    stand at one hour.  Hours and values (two decimals) are summed as exact integers and only the final quotients
    are rounded, so the order of rows does not matter.  One partial aggregate: no window, no list."""
    x, y = F.col("hours_in").cast("decimal(19,0)"), F.round(F.col("valuenum_avg") * 100).cast("decimal(19,0)")
    sums = trailing.filter(F.col("valuenum_avg").isNotNull()).groupBy("subject_id", "label").agg(
        F.count(F.lit(1)).alias("n"), F.max_by("valuenum_avg", "hours_in").alias("last"),
        F.sum(x).alias("_x"), F.sum(y).alias("_y"), F.sum(x * y).alias("_xy"), F.sum(x * x).alias("_xx"))
    over = F.expr("n * _xx - _x * _x").cast("double")
    return sums.select("subject_id", "label", "n", (F.col("_y").cast("double") / F.col("n").cast("double") / 100).alias("mean"), "last",
                       F.when(over > 0, F.expr("n * _xy - _x * _y").cast("double") / over / 100).alias("slope"))


def pivot_hourly(cells: DataFrame, labels: Sequence[str],
                 index: Sequence[str] = ("subject_id", "icustay_id", "hadm_id", "hours_in")) -> DataFrame:
    """A4: wide hourly frame, one column per label (mean of the cell values).

    The label list is explicit so the schema does not depend on the data;
    rows with no value at all are not produced.
    """
    v = cells.filter(F.col("valuenum_avg").isNotNull())
    return v.groupBy(*index).pivot("label", list(labels)).agg(F.avg("valuenum_avg"))


# --------------------------------------------------------------------------
# trailing window and regular hourly grid
# --------------------------------------------------------------------------

def last_hour(cells: DataFrame) -> DataFrame:
    """Last observed hour per subject (cells with a value only)."""
    return cells.filter(F.col("valuenum_avg").isNotNull()).groupBy("subject_id") \
        .agg(F.max("hours_in").alias("last_hour"))


def min_span(cells: DataFrame, hours: int) -> DataFrame:
    """Cells (with a value) of subjects whose last hour >= ``hours``."""
    last = last_hour(cells).filter(F.col("last_hour") >= hours)
    return cells.filter(F.col("valuenum_avg").isNotNull()).join(last.hint("merge"), "subject_id")


def trailing_window(cells: DataFrame, hours: int) -> DataFrame:
    """Cells with hours_in >= last_hour - hours (inclusive: hours+1 values)."""
    return min_span(cells, hours).filter(F.col("hours_in") >= F.col("last_hour") - hours)


def observed_hours(trailing: DataFrame) -> DataFrame:
    """Distinct (subject, hour) pairs that carry at least one value."""
    return trailing.select("subject_id", "hours_in", "last_hour").distinct()


def regularize(trailing: DataFrame, hours: int) -> DataFrame:
    """Grid of hours last-hours .. last per subject, flagged observed or padded."""
    last = trailing.select("subject_id", "last_hour").distinct()
    grid = last.select("subject_id", "last_hour",
                       F.explode(F.sequence(F.col("last_hour") - hours, F.col("last_hour"))).alias("hours_in"))
    obs = observed_hours(trailing).select("subject_id", "hours_in", F.lit(True).alias("observed"))
    return grid.join(obs, ["subject_id", "hours_in"], "left") \
        .withColumn("observed", F.coalesce(F.col("observed"), F.lit(False)))


def fill_backward(grid: DataFrame) -> DataFrame:
    """Each slot takes the whole row of the next observed hour
    (``src_hour``); a window over the subject's hours+1 slots only."""
    w = Window.partitionBy("subject_id").orderBy("hours_in") \
        .rowsBetween(Window.currentRow, Window.unboundedFollowing)
    src = F.first(F.when(F.col("observed"), F.col("hours_in")), ignorenulls=True).over(w)
    return grid.withColumn("src_hour", src)


def clip_last(df: DataFrame, n: int, order: str = "hours_in", key: str = "subject_id") -> DataFrame:
    """The last ``n`` rows per subject in time order, with ``step`` 0..n-1.

    ``row_number <= n`` lets Catalyst cut each group before the shuffle.
    """
    w = Window.partitionBy(key).orderBy(F.col(order).desc())
    return df.withColumn("_rk", F.row_number().over(w)).filter(F.col("_rk") <= n) \
        .withColumn("step", (F.lit(n) - F.col("_rk")).cast("int")).drop("_rk")


def hourly_slots(trailing: DataFrame, hours: int) -> DataFrame:
    """T7 -> T8 -> T9 in one bounded pass: (subject, step, hours_in, src_hour)
    for the last ``hours`` slots.

    A subject has at most hours+1 observed hours in its trailing window, so
    one aggregate per subject collects them (sorted), and array expressions
    build every slot with its source hour, the first observed hour at or
    after the slot.  One shuffle instead of the grid join and two windows of
    ``regularize`` -> ``fill_backward`` -> ``clip_last``; same rows.
    """
    per = trailing.groupBy("subject_id").agg(
        F.max("last_hour").alias("_last"), F.array_sort(F.collect_set("hours_in")).alias("_obs"))
    first_slot = F.col("_last") - (hours - 1)
    slots = F.transform(
        F.sequence(F.lit(0), F.lit(hours - 1)),
        lambda k: F.struct(k.cast("int").alias("step"), (first_slot + k).alias("hours_in"),
                           F.array_contains("_obs", first_slot + k).alias("observed"),
                           F.filter("_obs", lambda h: h >= first_slot + k)[0].alias("src_hour")))
    out = per.select("subject_id", F.col("_last").alias("last_hour"), F.explode(slots).alias("_s"))
    return out.select("subject_id", F.col("_s.hours_in").alias("hours_in"), "last_hour",
                      F.col("_s.observed").alias("observed"), F.col("_s.src_hour").alias("src_hour"),
                      F.col("_s.step").alias("step"))


def last_step(slots: DataFrame, hours: int) -> DataFrame:
    """The final slot of each subject's sequence."""
    return slots.filter(F.col("step") == hours - 1)
