"""Every stage against a brute-force version on the stage's own input."""
import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from tests.llm.test_bpe import library  # noqa: F401
from tests.llm.test_decontaminate import brute as brute_decontaminate
from tests.llm.test_simhash import brute as brute_simhash
from tests.llm.test_suffix_dedup import brute as brute_suffix
from wardlens.llm import quality, simhash
from wardlens.llm.shared import materialize, read

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark):
    """(input, output) of each stage."""
    docs, out = read(spark, SF, "documents"), []
    for name, f in P.STAGES:
        after = materialize(f(spark, docs, SF), "test-stage")
        out.append((docs, after))
        docs = after
    return out


def test_order_and_columns(stages):
    assert [n for n, _ in P.STAGES] == ["quality classifier", "simhash near-dedup", "suffix-array dedup", "benchmark decontamination", "bpe encoding"]
    assert all(after.columns == COLUMNS for _, after in stages[:-1])


def test_quality(spark, stages):
    before, after = stages[0]
    scored = quality.classify(before, read(spark, SF, "labels"))
    want = {r.doc_id for r in scored.collect() if r.predicted == 1}
    assert {r.doc_id for r in after.collect()} == want and 0 < len(want) < before.count()


def test_simhash(stages):
    before, after = stages[1]
    rows = [(r.doc_id, r.text) for r in before.collect()]
    assert {r.doc_id for r in after.collect()} == {c for _, _, c in brute_simhash(rows)}


def test_suffix(stages):
    before, after = stages[2]
    rows = {r.doc_id: r.text for r in before.collect()}
    kept = {r.doc_id: r for r in after.collect()}
    assert kept.keys() == rows.keys()
    for (d, t), (size, gone, _, digest) in zip(rows.items(), brute_suffix([t.encode() for t in rows.values()], 200)):
        got = kept[d]
        assert got.n_chars == len(got.text) and size - gone <= len(got.text.encode()) <= size
        if t.isascii():
            assert hashlib.sha256(got.text.encode()).hexdigest() == digest


def test_decontamination(spark, stages):
    before, after = stages[3]
    bench = [(r.item_id, r.text) for r in read(spark, SF, "benchmark").collect()]
    rows = [(r.doc_id, r.text) for r in before.collect()]
    want = {d for d, _, _, _, _, bad in brute_decontaminate(rows, bench) if not bad}
    assert {r.doc_id for r in after.collect()} == want


def test_encoding(stages, library):  # noqa: F811
    before, after = stages[4]
    texts = {r.doc_id: r.text for r in before.collect()}
    for r in after.collect():
        e = library.encode(texts[r.doc_id], add_special_tokens=False)
        assert r.ids == e.ids and r.n_tokens == len(e.ids) and r.decoded == library.decode(e.ids, skip_special_tokens=False)


def test_run(spark, stages):
    got = P.run(spark, SF).agg(F.count("*"), F.sum("n_tokens")).first()
    assert tuple(got) == tuple(stages[-1][1].agg(F.count("*"), F.sum("n_tokens")).first())
    assert np.array(got).all()


def test_simhash_stage_broadcasts_no_variants(spark, monkeypatch):
    """Its fingerprints times 64 would pass through the driver's memory, as Spark sizes them by the fingerprints alone."""
    docs = materialize(spark.range(200).select(F.col("id").alias("doc_id"), F.concat_ws(" ", *(F.hash("id", F.lit(k)) for k in range(8))).alias("text")), "few")
    plans = {}

    def noted(df, name):
        out = materialize(df, name)
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return out
    monkeypatch.setattr(simhash, "materialize", noted)
    assert P.simhash_near_dedup(spark, docs, SF).count() == 200
    assert "SortMergeJoin" in plans["simhash-edges"] and "BroadcastHashJoin" not in plans["simhash-edges"]
