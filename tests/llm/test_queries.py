"""The registered queries: SQL where SQL can express them, and the entry's guard."""
import duckdb
import pytest

import __spark_entry__ as entry
from wardlens.llm import queries
from wardlens.sources.tables import TABLES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    got, want = queries.QUERIES[name](spark, SF), con.execute(queries.ORACLE[name])
    cols = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(cols)
    norm = lambda rows: sorted(tuple("" if x is None or x != x else str(x) for x in r) for r in rows)
    assert norm(got.select(*cols).collect()) == norm(want.fetchall())


def test_every_operator_is_registered():
    names = [n for n in entry.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert "pipeline" in entry.queries()
