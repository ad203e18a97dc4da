"""A subject holding a third of all rows: results are identical when AQE is
forced to split skewed partitions (tiny thresholds) and when it is not."""

from datetime import datetime, timedelta

from wardlens.operators import features, series

T0 = datetime(2021, 3, 1)
SKEW_CONF = {
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1KB",
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
}


def _measurements(spark):
    rows = []
    for i in range(6000):  # hot subject: one third of all rows
        rows.append((1, 1, 1, ["hr", "bp"][i % 2], i % 3, T0 + timedelta(minutes=i), float(i % 97)))
    for s in range(2, 402):
        for i in range(30):
            rows.append((s, s, s, ["hr", "bp"][i % 2], i % 3, T0 + timedelta(minutes=7 * i + s), float((s * i) % 89)))
    return spark.createDataFrame(rows, "subject_id long, hadm_id long, icustay_id long, label string, "
                                       "itemid long, charttime timestamp_ntz, valuenum double")


def _run(spark):
    m = _measurements(spark)
    hours = series.with_hours(m)
    cells = series.hourly_average(hours)
    trail = series.trailing_window(cells, 4)
    words = features.zscore_words(trail, features.feature_stats(trail))
    run = series.running_average(hours)
    return (sorted(tuple(r) for r in cells.collect()), sorted(tuple(r) for r in words.collect()),
            sorted(tuple(r) for r in run.select("subject_id", "label", "hours_in", "itemid",
                                                 "valuenum_running_avg").collect()))


def test_results_do_not_depend_on_skew_splitting(spark):
    base = _run(spark)
    old = {k: spark.conf.get(k, None) for k in SKEW_CONF}
    try:
        for k, v in SKEW_CONF.items():
            spark.conf.set(k, v)
        skewed = _run(spark)
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
    assert base == skewed
    assert len(base[0]) > 0 and len(base[1]) > 0


def test_row_number_within_hot_key_equals_window(spark):
    from pyspark.sql import Window
    from pyspark.sql import functions as F
    from wardlens.operators.ranking import row_number_within
    rows = [(1, i % 500, i) for i in range(3000)]  # hot key with many ties on the first order column
    rows += [(k, (k * 7 + j) % 13, j) for k in range(2, 600) for j in range(3)]
    rows += [(None, 1, 1), (None, 0, 2), (5, None, 9)]
    df = spark.createDataFrame(rows, "k long, t long, id long")
    order = [F.col("t").asc_nulls_last(), F.col("id").asc_nulls_last()]
    got = row_number_within(df, "k", order, "rn", partitions=7)
    ref = df.withColumn("rn", F.row_number().over(Window.partitionBy("k").orderBy(*order)))
    key = lambda r: tuple((x is None, x or 0) for x in r)
    a = sorted((tuple(r) for r in got.select("k", "t", "id", "rn").collect()), key=key)
    b = sorted((tuple(r) for r in ref.select("k", "t", "id", "rn").collect()), key=key)
    assert a == b
