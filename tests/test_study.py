"""The generic study API on the fixture roles reproduces the registered queries."""

from wardlens.functions.codesets import FIXTURE
from wardlens.plans import q_features, q_learn
from wardlens.plans.study import StudyTables, prepare
from wardlens.sources import roles
from wardlens.sources.tables import Tables

SF = "/root/testdata/sf0.01"


def test_prepare_equals_registered_queries(spark):
    t = Tables(spark, SF)
    items = roles.item_dictionary(spark)
    tables = StudyTables(stays=roles.stays(t), subjects=roles.subjects(t), visits=roles.visits(t),
                         code_dictionary=roles.code_dictionary(t), code_facts=roles.code_facts(t),
                         lab_events=roles.lab_events(t), lab_items=items, chart_events=roles.chart_events(t),
                         chart_items=items, deaths=roles.deaths(t))
    study = prepare(tables, FIXTURE, chart_keys=("subject_id",))
    got = sorted(tuple(r) for r in study.model_table.collect())
    ref = sorted(tuple(r) for r in q_features.fixture_table(Tables(spark, SF)).collect())
    assert got == ref and len(got) > 10000
    a = sorted((r["subject_id"], r["split"], tuple(sorted(r["tokens"]))) for r in study.model_rows.collect())
    b = sorted((r["subject_id"], r["split"], tuple(sorted(r["tokens"])))
               for r in q_learn.fixture_model_rows(Tables(spark, SF)).collect())
    assert a == b


def test_a_stored_clustering_serves_a_later_study(spark):
    """Fit on one run of the study, assign in another: the same clusters, also for subjects of other splits."""
    import tempfile

    from wardlens.plans.study import cluster_cohorts
    t = Tables(spark, SF)
    items = roles.item_dictionary(spark)
    tables = StudyTables(stays=roles.stays(t), subjects=roles.subjects(t), visits=roles.visits(t), code_dictionary=roles.code_dictionary(t),
                         code_facts=roles.code_facts(t), lab_events=roles.lab_events(t), lab_items=items, chart_events=roles.chart_events(t),
                         chart_items=items, deaths=roles.deaths(t))
    params = FIXTURE | {"embedding_size": 6, "clusters": 3, "cluster_starts": 3, "cluster_tol": 1e-4}
    path = tempfile.mkdtemp(prefix="wardlens-clustering-")
    first = cluster_cohorts(prepare(tables, params, chart_keys=("subject_id",)), params, path=path)
    later = cluster_cohorts(prepare(tables, params, chart_keys=("subject_id",)), params, path=path, load=True)
    rows = sorted(map(tuple, first.collect()))
    assert rows == sorted(map(tuple, later.collect())) and len(rows) == 90 and len({r[1] for r in rows}) > 1
