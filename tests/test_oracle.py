"""Every query with an oracle matches DuckDB at sf0.001; the others return rows."""

import math

import duckdb
import pytest

import __spark_entry__ as E
from wardlens.sources.tables import TABLES

SF = "/root/testdata/sf0.001"
QUERIES = E.queries()
ORACLE = E.oracle_sql()
SUBJECTS = "model_rows"  # its rows are the subjects of every learning query


def _norm(v):
    if v is None:
        return (0, "")
    if isinstance(v, float):
        return (1, "nan") if math.isnan(v) else (2, v)
    if isinstance(v, bool):
        return (2, float(v))
    if isinstance(v, int):
        return (2, float(v))
    if hasattr(v, "isoformat"):
        return (3, v.isoformat())
    if isinstance(v, (list, tuple)):
        return (4, repr([_norm(x) for x in v]))
    return (5, str(v))


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.fixture(scope="module")
def frame(spark):
    """Each query's DataFrame, built once: building fits models and writes intermediate tables."""
    built = {}

    def get(name):
        if name not in built:
            built[name] = QUERIES[name](spark, SF)
        return built[name]
    return get


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_oracle(frame, con, name):
    sdf = frame(name)
    cols = sorted(sdf.columns)
    srows = sorted(tuple(_norm(r[c]) for c in cols) for r in sdf.collect())
    cur = con.execute(ORACLE[name])
    ocols = [d[0] for d in cur.description]
    assert sorted(ocols) == cols
    orows = sorted(tuple(_norm(dict(zip(ocols, r))[c]) for c in cols) for r in cur.fetchall())
    assert srows == orows


SPARK_TO_DUCK = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
                 "boolean": "BOOLEAN", "date": "DATE", "timestamp_ntz": "TIMESTAMP", "array<string>": "VARCHAR[]",
                 "array<int>": "INTEGER[]"}


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_types_match_oracle(frame, con, name):
    sdt = dict(frame(name).dtypes)
    rel = con.sql(ORACLE[name])
    odt = dict(zip(rel.columns, [str(t) for t in rel.types]))
    assert {c: SPARK_TO_DUCK.get(t, t) for c, t in sdt.items()} == odt


def test_embedding_and_clusters_cover_every_subject(frame):
    subjects = frame(SUBJECTS).count()
    e = frame("embed_sequences").collect()
    assert len(e) == subjects and len({len(r["embedding"]) for r in e}) == 1
    assert all(math.isfinite(x) for r in e for x in r["embedding"])
    c = frame("cluster_fit_assign").collect()
    assert len(c) == subjects and {r["cluster"] for r in c} <= set(range(4))


@pytest.mark.parametrize("name", ["model_global", "model_separate", "model_multitask"])
def test_model_queries_report_every_scope(frame, name):
    scopes = {(r["scope"], r["n_pos"] > 0 and r["n_neg"] > 0) for r in frame("separate_scored_scopes").collect()}
    got = {r["scope"]: r["auc"] for r in frame(name).collect()}
    assert set(got) == {s for s, _ in scopes} | {"macro"}
    assert all((got[s] is not None) == both for s, both in scopes)
    assert all(v is None or 0 <= v <= 1 for v in got.values())


@pytest.mark.parametrize("name,metrics", [("run_experiment", {"auc", "auc_min", "auc_max", "auc_mean"}), ("cluster_cohort_models", {"auc"})])
def test_experiments_report_their_metrics(frame, name, metrics):
    rows = frame(name).collect()
    assert {r["metric"] for r in rows} == metrics and {"macro", "micro"} <= {r["scope"] for r in rows}


def test_entry(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert "readmission_30_days" in df.columns
