import hashlib

from pyspark.sql import functions as F

from wardlens.llm import warc


def leaves(spark, rows):
    return spark.createDataFrame(rows, "file long, offset long, size long, digest string").withColumns({c: F.lit(0) for c in ("node", "up", "root")})


def archive(n=300, step=700):
    return [(f, i * step, step, hashlib.sha256(f"{f}/{i}".encode()).hexdigest()) for f in range(3) for i in range(n)]


def test_finds_every_damage_and_opens_few_nodes(spark):
    a = archive()
    b = [(f, o, s, "0" * 64 if (f, o) in {(1, 700), (1, 140000)} else d) for f, o, s, d in a if (f, o) != (2, 2100)]
    b.append((7, 0, 1, "f"))
    out = {r.file: r for r in warc.audit(leaves(spark, a), leaves(spark, b), range_bits=12, fan_bits=2, levels=4).collect()}
    assert out[0].intact and out[0].compared == 0 and out[0].damaged == ""
    assert out[1].damaged == "700,140000" and out[1].n_damaged == 2 and 0 < out[1].compared < 60
    assert out[2].damaged == "2100" and out[7].damaged == "0" and out[7].root is None and out[7].n_records == 0
    assert out[1].n_records == 300 and out[1].n_bytes == 210000


def test_repeated_offsets_and_empty_replicas(spark):
    a = [(0, 0, 5, "a"), (0, 0, 5, "b"), (0, 9, 5, "c")]
    assert [r.intact for r in warc.audit(leaves(spark, a), leaves(spark, a[::-1])).collect()] == [True]
    assert [r.damaged for r in warc.audit(leaves(spark, a), leaves(spark, a[1:])).collect()] == ["0"]
    none = leaves(spark, a).filter("false")
    assert [(r.root, r.damaged) for r in warc.audit(none, leaves(spark, a)).collect()] == [(None, "0,9")]
    assert warc.audit(none, none).count() == 0


def test_pages_with_nulls_repeats_and_long_texts(spark):
    rows = [(i // 2 if i % 9 else None, None if i % 5 == 0 else f"http://h/{i}", None if i % 7 == 0 else "x" * (i * 50)) for i in range(200)]
    rows += [(3, "same", "same")] * 20 + [(400, "u", "y" * 300000)]
    d = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit("z") for c in ("file", "offset", "size", "digest", "lost")})
    clean = warc.audit_pages(d, F.lit(False), F.lit(None).cast("boolean")).collect()
    assert all(r.intact for r in clean) and sum(r.n_records for r in clean) == len(rows)
    bad = warc.audit_pages(d, F.col("page_id") == 400, F.col("page_id") == 0).collect()
    lost = sum(1 for r in rows if r[0] == 0)
    assert sum(r.n_damaged for r in bad) == 1 + lost
    assert warc.audit_pages(d.filter("false"), F.lit(True), F.lit(True)).count() == 0


def test_record_format(spark):
    r = spark.createDataFrame([(7, "http://a/", "é")], "page_id long, url string, html string").select(
        warc.record(F.col("url"), F.col("html"), F.col("page_id"))).first()[0]
    assert r == ("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:7>\r\nWARC-Target-URI: http://a/\r\n"
                 "Content-Type: text/html\r\nContent-Length: 2\r\n\r\né\r\n\r\n")
