"""Property tests: exact AUC against brute-force pair counting, exact split sizes."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wardlens.operators import evaluate, sampling

rows_st = st.lists(st.tuples(st.integers(0, 6), st.integers(0, 1), st.sampled_from(["a", "b", "c"]),
                             st.integers(1, 3)), min_size=1, max_size=60)


def _brute(rows):
    """AUC per scope by counting (positive, negative) pairs; ties count one half."""
    out = {}
    for scope in {r[2] for r in rows}:
        pos = [(s, w) for s, y, c, w in rows if c == scope and y == 1]
        neg = [(s, w) for s, y, c, w in rows if c == scope and y == 0]
        p, n = sum(w for _, w in pos), sum(w for _, w in neg)
        if p == 0 or n == 0:
            out[scope] = None
            continue
        u = sum(wp * wn * (1.0 if sp > sn else 0.5 if sp == sn else 0.0) for sp, wp in pos for sn, wn in neg)
        out[scope] = u / (p * n)
    return out


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows=rows_st)
def test_auc_equals_pair_count(spark, rows):
    df = spark.createDataFrame([(float(s) / 7, y, c, w) for s, y, c, w in rows],
                               "score double, y int, c string, w int")
    got = {r["c"]: r["auc"] for r in evaluate.auc(df, "y", "score", ["c"], weight="w", range_cells=7).collect()}
    exp = _brute([(float(s) / 7, y, c, w) for s, y, c, w in rows])
    assert got.keys() == exp.keys()
    for k in exp:
        assert (got[k] is None) == (exp[k] is None)
        if exp[k] is not None:
            assert abs(got[k] - exp[k]) < 1e-12


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(n0=st.integers(1, 120), n1=st.integers(1, 40), seed=st.integers(0, 5))
def test_split_sizes_exact(spark, n0, n1, seed):
    df = spark.range(0, n0 + n1).select(F.col("id").alias("sid"), (F.col("id") >= n0).cast("int").alias("y"))
    out = sampling.stratified_split(df, "y", "sid", seed=seed, buckets=8)
    counts = {(r["y"], r["split"]): r["count"] for r in out.groupBy("y", "split").count().collect()}
    for y, n in ((0, n0), (1, n1)):
        n_test = -(-n // 5)
        n_val = -(-(n - n_test) // 8)
        assert counts.get((y, "test"), 0) == n_test
        assert counts.get((y, "val"), 0) == n_val
        assert counts.get((y, "train"), 0) == n - n_test - n_val


keyed_st = st.lists(st.tuples(st.integers(0, 3), st.one_of(st.none(), st.integers(0, 5)), st.integers(0, 10_000)),
                    min_size=1, max_size=80, unique_by=lambda r: r[2])


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows=keyed_st, parts=st.integers(1, 9))
def test_row_number_within_equals_window(spark, rows, parts):
    from pyspark.sql import Window
    from wardlens.operators.ranking import row_number_within
    df = spark.createDataFrame(rows, "k long, t long, id long")
    order = [F.col("t").asc_nulls_last(), F.col("id").asc_nulls_last()]
    got = {r["id"]: r["rn"] for r in row_number_within(df, "k", order, "rn", partitions=parts).collect()}
    ref = {r["id"]: r["rn"] for r in
           df.withColumn("rn", F.row_number().over(Window.partitionBy("k").orderBy(*order))).collect()}
    assert got == ref


hours_st = st.dictionaries(st.integers(1, 6), st.sets(st.integers(0, 200), min_size=1, max_size=25),
                           min_size=1, max_size=5)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(by_subject=hours_st, n=st.sampled_from([3, 12, 48]))
def test_one_pass_slots_equal_window_chain(spark, by_subject, n):
    from wardlens.operators import series
    rows = [(s, 1, 1, "hr", h, 1.0, 1) for s, hs in by_subject.items() for h in hs]
    cells = spark.createDataFrame(rows, "subject_id long, icustay_id long, hadm_id long, label string, "
                                        "hours_in long, valuenum_avg double, n_measures long")
    trail = series.trailing_window(cells, n)
    cols = ["subject_id", "hours_in", "last_hour", "observed", "src_hour", "step"]
    a = sorted(tuple(r) for r in series.hourly_slots(trail, n).select(*cols).collect())
    b = sorted(tuple(r) for r in series.clip_last(series.fill_backward(series.regularize(trail, n)), n)
               .select(*cols).collect())
    assert a == b


@settings(max_examples=6, deadline=None)
@given(st.lists(st.tuples(st.sampled_from([None, 1, 2]), st.integers(0, 6), st.sampled_from([None, 0, 1])), min_size=30, max_size=80))
def test_null_keys_in_numbering_and_running_max(spark, rows):
    from pyspark.sql import Window
    from pyspark.sql import functions as F
    from wardlens.operators.flags import running_max
    from wardlens.operators.ranking import row_number_within
    d = spark.createDataFrame([(k, o, f, i) for i, (k, o, f) in enumerate(rows)], "k int, o int, f int, i int")
    got = row_number_within(d, "k", [F.col("o"), F.col("i")], "rn", partitions=7)
    want = d.withColumn("rn", F.row_number().over(Window.partitionBy("k").orderBy("o", "i")))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    fast, plain = (running_max(d, "k", "o", ["f"], binary=b) for b in (True, False))
    assert sorted(map(str, fast.collect())) == sorted(map(str, plain.collect()))
