"""WARC fixity audit with Merkle trees, in DataFrame expressions.

Each record is hashed where it is read; only digests travel.  A file's tree has
the records as leaves and ordered offset ranges as inner nodes: a node of level
k covers the offsets of one range of ``2 ** (RANGE_BITS + (k - 1) * FAN_BITS)``
bytes and hashes the (offset, digest) list below it, in offset order.  Ranges
bound a node by bytes of archive, however many rows a file, host or page has,
and a lost record changes only the nodes that cover its offset.

Two replicas are compared by their roots; only below nodes that differ are the
next level's nodes compared, down to the records.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardlens.llm.shared import materialize
from wardlens.operators.ranking import row_number_within

RECORDS_PER_FILE = 1024
RANGE_BITS = 16   # lowest ranges: 64 KB
FAN_BITS = 4      # sixteen ranges of one level make one of the next
LEVELS = 4        # up to 2 ** 28 bytes a range; a root covers all ranges of its file


def record(url: Column, payload: Column, record_id: Column) -> Column:
    """A WARC/1.1 resource record; nulls are empty."""
    url, payload = F.coalesce(url, F.lit("")), F.coalesce(payload, F.lit(""))
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:"), F.coalesce(record_id.cast("string"), F.lit("")),
        F.lit(">\r\nWARC-Target-URI: "), url, F.lit("\r\nContent-Type: text/html\r\nContent-Length: "),
        F.octet_length(payload).cast("string"), F.lit("\r\n\r\n"), payload, F.lit("\r\n\r\n"))


def place_records(leaves: DataFrame, order: list[str], records_per_file: int = RECORDS_PER_FILE) -> DataFrame:
    """Add file and offset to rows with ``size``: files of ``records_per_file`` records in the total
    order of ``order``.  Rows are numbered range by range; rows that are equal in all of ``order`` share a
    range, so ``order`` must tell rows apart as far as they differ."""
    numbered = row_number_within(leaves.withColumn("_all", F.lit(0)), "_all", [F.col(c).asc_nulls_first() for c in order], "_rn").drop("_all")
    placed = numbered.withColumn("file", F.floor((F.col("_rn") - 1) / records_per_file))
    before = Window.partitionBy("file").orderBy("_rn").rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum("size").over(before), F.lit(0))).drop("_rn")


def _hash_of(children: Column) -> Column:
    """Digest of a node: its children's (place, digest) in order."""
    return F.sha2(F.array_join(F.transform(F.array_sort(children), lambda c: F.concat(
        c["at"].cast("string"), F.lit(":"), c["digest"])), ";"), 256)


def tree(leaves: DataFrame, range_bits: int = RANGE_BITS, fan_bits: int = FAN_BITS, levels: int = LEVELS) -> list[DataFrame]:
    """Levels 0 (leaves) to ``levels`` + 1 (roots) as (file, node, up, digest); ``node`` is the offset of a
    record or the number of a range, ``up`` the node above.  Rows that repeat an offset count as
    one leaf that hashes all of them.  Every level but the leaves is written, so the next one is built from its rows."""
    base = leaves.groupBy("file", F.col("offset").alias("node")).agg(F.sort_array(F.collect_list("digest")).alias("d")).select(
        "file", "node", F.when(F.size("d") == 1, F.col("d")[0]).otherwise(F.sha2(F.array_join("d", ","), 256)).alias("digest"))
    out, bits = [], range_bits
    for k in range(levels + 1):
        up = F.shiftright("node", bits if k == 0 else fan_bits) if k < levels else F.lit(0).cast("long")
        base = base.withColumn("up", up)
        out.append(base)
        base = materialize(base.groupBy("file", F.col("up").alias("node")).agg(
            _hash_of(F.collect_list(F.struct(F.col("node").alias("at"), "digest"))).alias("digest")), "warc-nodes")
    return [*out, base.withColumn("up", F.lit(0).cast("long"))]


def audit(left: DataFrame, right: DataFrame, **shape) -> DataFrame:
    """One row per file of either replica (rows: file, offset, size, digest): n_records and n_bytes of the left
    one, root, replica_root (null: no such file), intact, compared (nodes compared below the root),
    n_damaged, damaged (comma-joined offsets whose records differ or stand in one replica only).

    Only children of differing nodes are compared.  Empty replicas give no rows."""
    a, b = (tree(x, **shape) for x in (left, right))

    def compare(x: DataFrame, y: DataFrame) -> DataFrame:
        return x.select("file", "node", F.col("up").alias("ul"), F.col("digest").alias("dl")).join(
            y.select("file", "node", F.col("up").alias("ur"), F.col("digest").alias("dr")), ["file", "node"], "full").select(
            "file", "node", F.coalesce("ul", "ur").alias("up"), "dl", "dr", (~F.col("dl").eqNullSafe(F.col("dr"))).alias("differs"))

    roots = materialize(compare(a[-1], b[-1]), "warc-roots")
    open_ = roots.filter("differs").select("file", F.col("node").alias("up"))
    compared = None
    for x, y in zip(reversed(a[:-1]), reversed(b[:-1])):
        below = compare(*(z.join(open_, ["file", "up"], "left_semi") for z in (x, y)))
        below = materialize(below, "warc-level")
        seen = below.groupBy("file").agg(F.count(F.lit(1)).alias("compared"))
        compared = seen if compared is None else compared.union(seen)
        open_ = below.filter("differs").select("file", F.col("node").alias("up"))
    damaged = open_.groupBy("file").agg(F.sort_array(F.collect_list("up")).alias("d"))
    sizes = left.groupBy("file").agg(F.count(F.lit(1)).alias("n_records"), F.sum("size").alias("n_bytes"))
    zero = F.lit(0).cast("long")
    return roots.join(sizes, "file", "left").join(compared.groupBy("file").agg(F.sum("compared").alias("compared")), "file", "left") \
        .join(damaged, "file", "left").select(
            "file", F.coalesce("n_records", zero).alias("n_records"), F.coalesce("n_bytes", zero).alias("n_bytes"),
            F.col("dl").alias("root"), F.col("dr").alias("replica_root"), (~F.col("differs")).alias("intact"),
            F.coalesce("compared", zero).alias("compared"), F.coalesce(F.size("d").cast("long"), zero).alias("n_damaged"),
            F.coalesce(F.array_join("d", ","), F.lit("")).alias("damaged"))


def audit_pages(pages: DataFrame, spoiled: Column, lost: Column) -> DataFrame:
    """Archive ``pages`` (page_id, url, html) in WARC files and audit a replica in which the payloads of
    ``spoiled`` rows have their first character changed and ``lost`` rows are missing."""
    html = F.coalesce("html", F.lit(""))
    bad = F.concat(F.when(F.substring(html, 1, 1) == "#", "?").otherwise("#"), F.substring(html, 2, 2147483646))
    whole, rotten = (record(F.col("url"), x, F.col("page_id")) for x in (html, F.when(spoiled, bad).otherwise(html)))
    leaves = pages.select("page_id", "url", F.octet_length(whole).cast("long").alias("size"), F.sha2(whole, 256).alias("digest"),
                          F.sha2(rotten, 256).alias("other"), F.coalesce(lost, F.lit(False)).alias("lost"))
    placed = materialize(place_records(leaves, ["page_id", "url", "digest"]).select("file", "offset", "size", "digest", "other", "lost"), "warc-leaves")
    return audit(placed.select("file", "offset", "size", "digest"),
                 placed.filter("NOT lost").select("file", "offset", "size", F.col("other").alias("digest")))
