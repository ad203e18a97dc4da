"""Exact ``row_number() OVER (PARTITION BY key ORDER BY ...)`` with no
window larger than one range partition, for keys that may hold a large
share of all rows.

1. ``repartitionByRange`` on (key, order...) gives partitions of similar
   size whose ranges are ordered, so a hot key is spread over many
   consecutive partitions.
2. Rows are numbered inside their (partition, key) group only.
3. A key's rows in earlier partitions shift its numbers (the ranged rows
   are written once, so every step reads the same partition ids).  Only keys that
   cross a partition boundary need a shift; each partition has at most two
   such keys (its first and its last), so the shift table holds at most
   about 2 x partitions rows and is broadcast with that bound.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardlens.sources.sinks import materialize


def row_number_within(df: DataFrame, key: str, order: Sequence[Column], name: str = "rn",
                      partitions: int | None = None) -> DataFrame:
    """Add ``name`` = 1-based position of each row within its key by ``order``
    (sort columns, e.g. ``F.col("t").asc_nulls_last()``); the order must be
    total within a key for a deterministic result."""
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, F.col(key).asc_nulls_last(), *order) \
        .withColumn("_pid", F.spark_partition_id())
    # Both branches below must see the same partition ids; range bounds are
    # sampled from the input, whose row order may differ between two
    # evaluations, so the ranged rows are written once and read back.
    ranged = materialize(ranged, "ranged")
    local = Window.partitionBy("_pid", key).orderBy(*order)
    x = ranged.withColumn("_r", F.row_number().over(local))
    per = ranged.groupBy("_pid", key).agg(F.count(F.lit(1)).alias("_c"))
    per = per.withColumn("_parts", F.count(F.lit(1)).over(Window.partitionBy(key)))
    shifts = per.filter(F.col("_parts") > 1).select(
        F.col("_pid").alias("_spid"), F.col(key).alias("_skey"),
        (F.sum("_c").over(Window.partitionBy(key).orderBy("_pid")) - F.col("_c")).alias("_off"))
    # a NULL key is a key like any other
    out = x.join(F.broadcast(shifts), (x["_pid"] == shifts["_spid"]) & x[key].eqNullSafe(shifts["_skey"]), "left") \
        .drop("_spid", "_skey")
    return out.withColumn(name, (F.col("_r") + F.coalesce(F.col("_off"), F.lit(0))).cast("int")) \
        .drop("_pid", "_r", "_off")


def sum_before(df: DataFrame, keys: Sequence[str], order: str, value: str, name: str, range_rows: int) -> DataFrame:
    """Add ``name``: the sum of ``value`` (double) over the rows of the same keys with a smaller ``order``.

    (keys, order) must not repeat.  The rows are written and counted; up to ``range_rows`` of them go through one
    window by key.  More are cut into as many ranges of (keys, order) as it takes for some ``range_rows`` each: a
    window sums inside a (range, key), and the sums of a key's earlier ranges are added.  Only keys that cross a
    range's border need them, at most two a range, so that table is broadcast."""
    keys = list(keys)
    zero = F.lit(0.0)
    rows = materialize(df, "ordered")
    n = rows.count()
    own = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(F.col(order).asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    if n <= range_rows:
        return rows.withColumn(name, F.coalesce(F.sum(value).over(own), zero))
    by = [F.col(c).asc_nulls_first() for c in [*keys, order]]
    ranged = rows.repartitionByRange(-(-n // range_rows), *by).withColumn("_pid", F.spark_partition_id())
    ranged = materialize(ranged, "ranged")  # every step below must see the same ranges
    local = Window.partitionBy("_pid", *keys).orderBy(F.col(order).asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    per = ranged.groupBy("_pid", *keys).agg(F.sum(value).alias("_v"))
    every = Window.partitionBy(*(keys or [F.lit(0)]))
    per = per.withColumns({"_parts": F.count(F.lit(1)).over(every), "_before": F.coalesce(F.sum("_v").over(
        every.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), zero)}).filter("_parts > 1")
    shifts = per.select(F.col("_pid").alias("_spid"), *(F.col(k).alias(f"_s{i}") for i, k in enumerate(keys)), "_before")
    same = F.col("_pid") == F.col("_spid")
    for i, k in enumerate(keys):  # a NULL key is a key like any other
        same &= F.col(k).eqNullSafe(F.col(f"_s{i}"))
    out = ranged.withColumn("_own", F.coalesce(F.sum(value).over(local), zero)).join(F.broadcast(shifts), same, "left")
    return out.withColumn(name, F.col("_own") + F.coalesce("_before", zero)).select(*rows.columns, name)
