"""SimHash near-dedup by deletion-variant signatures.

A document's fingerprint has a 1 where more than half of its shingle hashes
have one.  Two fingerprints are linked at ``max_bits`` (3) or fewer differing
bits.  The 64 bits are cut into two segments of 32: of at most three differing
bits one segment holds at most one.  Each distinct fingerprint is indexed under
32 variants of each segment, with one bit deleted (masked) per variant; two
segments at most one bit apart share a variant, so an equality join on
(segment, deleted bit, masked value) meets every link, and each meeting is
verified on the whole fingerprint.

Skew.  Documents are first reduced to distinct fingerprints, so exact copies
cost one row.  A variant under which many distinct fingerprints meet is cut
again by the other segment's four bytes: of at most three differing bits at
least one byte is untouched, so every link still meets under (variant, byte
number, byte value).  A variant beyond ``CROWDED`` is cut by five of the other
segment's eight half-bytes instead: at least five are untouched, and with 31 + 20
bits given at most 2 ** 13 distinct fingerprints can share a bucket, whatever the
data.  Within one bucket the verified links are reduced to a
spanning forest before anything is emitted: never all pairs.

Components come from min-label propagation with pointer jumping over tables
written to the shared folder; nothing is collected to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wardlens.llm.shared import materialize, partitions, small_batches, unused

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
HOT_BUCKET = 256   # distinct fingerprints under one variant beyond which it is cut by bytes
CROWDED = 8192     # ... and beyond which it is cut by five half-bytes
SEGMENT = 0xFFFFFFFF
HALF_BYTES = [sum(15 << 4 * i for i in five) for five in combinations(range(8), 5)]


def shingle_hashes(text: bytes, size: int = 3, seed: int = 42) -> list[int]:
    """XXH64 of every ``size``-word shingle, repeats included, words joined by one space;
    a text of fewer words has one shingle, a text of none has none."""
    words = text.translate(LOWER).split()  # ASCII white space: \x20 and \x09-\x0D
    if not words:
        return []
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = (ends - np.diff(ends, prepend=0)).tolist()
    ends = (ends - 1).tolist()
    digest = xxhash.xxh64_intdigest
    if len(words) <= size:
        return [digest(line, seed)]
    return [digest(line[s:e], seed) for s, e in zip(starts, ends[size - 1:])]


def majority(hashes: list[int]) -> int:
    """Bit i is 1 if more than half of the hashes have it; none: zero."""
    if not hashes:
        return 0
    h = np.array(hashes, dtype=np.uint64).astype(">u8").view(np.uint8).reshape(-1, 8)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 65536):
        ones += np.unpackbits(h[at:at + 65536], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(h)).tobytes(), "big")


def fingerprints(docs: DataFrame, size: int = 3, seed: int = 42, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """(doc_id, text_key: hash of the text, fp bigint: the 64 bits as a signed number), one row per input row.

    Null or empty texts get fingerprint zero.  Other columns are not read."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(2)
            out = np.array([majority(shingle_hashes(t.as_py() or b"", size, seed)) for t in texts], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out.view(np.int64))],
                                             ["doc_id", "text_key", "fp"])

    src = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_key"),
                      F.col(text_col).cast("binary").alias("text"))
    return small_batches(src).mapInArrow(run, f"doc_id {dict(src.dtypes)['doc_id']}, text_key bigint, fp bigint")


def forest(fp: np.ndarray, max_bits: int, block: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest (as index pairs) of the links among the distinct fingerprints of one bucket.

    Distances are taken block by block: memory stays at ``block`` x bucket, and the steps
    outside numpy are one per fingerprint and one per edge of the forest."""
    n = len(fp)
    label = np.arange(n)
    left, right = [], []
    for at in range(0, n, block):
        close = np.bitwise_count(fp[at:at + block, None] ^ fp[None, at:]) <= max_bits
        for i, row in enumerate(close, at):
            near = np.flatnonzero(row) + at
            kinds, one = np.unique(label[near], return_index=True)
            for kind, j in zip(kinds, near[one]):
                if kind != label[i]:
                    left.append(i)
                    right.append(int(j))
                    label[label == kind] = label[i]
    return np.array(left, np.int64), np.array(right, np.int64)


def _bucket_links(max_bits: int):
    """mapInArrow over rows sorted by bucket (k1, k2): links of each bucket."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep: list[np.ndarray] = []  # the bucket that the last batch left open
        for b in batches:
            rows = np.stack([b.column(i).to_numpy(zero_copy_only=False) for i in range(3)])
            if keep:
                rows = np.concatenate([*keep, rows], axis=1)
            if not rows.shape[1]:
                continue
            new = np.flatnonzero(np.any(rows[:2, 1:] != rows[:2, :-1], axis=0)) + 1
            last = int(new[-1]) if len(new) else 0
            keep = [rows[:, last:]]
            yield from _links(rows[:, :last], new[:-1] if len(new) else new, max_bits)
        if keep:
            yield from _links(keep[0], np.zeros(0, np.int64), max_bits)

    return run


def _links(rows: np.ndarray, cuts: np.ndarray, max_bits: int) -> Iterator[pa.RecordBatch]:
    n = rows.shape[1]
    if n < 2:
        return
    fp = rows[2].view(np.uint64) if rows[2].flags.c_contiguous else np.ascontiguousarray(rows[2]).view(np.uint64)
    starts = np.concatenate(([0], cuts))
    sizes = np.diff(np.append(starts, n))
    a, b = [], []
    # small buckets: neighbours at distance 1, 2, ... in the sorted rows, all buckets at once
    small = np.repeat(sizes <= 8, sizes)
    bucket = np.repeat(np.arange(len(sizes)), sizes)
    for step in range(1, 8):
        if step >= n:
            break
        near = (bucket[step:] == bucket[:-step]) & small[step:]
        near &= np.bitwise_count(fp[step:] ^ fp[:-step]) <= max_bits
        i = np.flatnonzero(near)
        a.append(fp[i])
        b.append(fp[i + step])
    for k in np.flatnonzero(sizes > 8):
        own = np.unique(fp[starts[k]:starts[k] + sizes[k]])
        i, j = forest(own, max_bits)
        a.append(own[i])
        b.append(own[j])
    a, b = np.concatenate(a), np.concatenate(b)
    diff = a != b
    if diff.any():
        yield pa.RecordBatch.from_arrays([pa.array(a[diff].view(np.int64)), pa.array(b[diff].view(np.int64))], ["a", "b"])


def links(fps: DataFrame, max_bits: int = 3, hot: int = HOT_BUCKET, crowded: int = CROWDED) -> DataFrame:
    """(a, b): links between distinct fingerprints that join the same components as all links.

    ``fps`` has one bigint column ``fp`` without repeats.  Exact for max_bits <= 3."""
    if not 0 <= max_bits <= 3:
        raise ValueError("two segments of one deletion each are exact for at most 3 differing bits")
    low = F.col("fp").bitwiseAND(F.lit(SEGMENT))
    high = F.shiftrightunsigned("fp", 32)
    variants = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.struct(
        (F.when(i < 32, low).otherwise(high).bitwiseAND(F.lit(SEGMENT) - F.call_function("shiftleft", F.lit(1).cast("bigint"), i % 32))
         + i.cast("bigint") * F.lit(1 << 32)).alias("k1")))
    n = partitions(fps.sparkSession)
    # dealt out first, by an expression that no earlier exchange deals by: each fingerprint becomes 64 rows
    index = fps.repartition(n, F.xxhash64("fp")).select("fp", F.explode(variants).alias("v")).select("fp", F.col("v.k1").alias("k1"))
    crowd = index.groupBy("k1").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    # both sides have up to 64 rows per fingerprint, but Spark sizes them as before the explode and would broadcast one
    met = index.join(crowd.hint("merge"), "k1")
    other = F.when(F.col("k1") < (32 << 32), high).otherwise(low)
    byte = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: (
        i.cast("bigint") * 256 + F.call_function("shiftrightunsigned", other, i * 8).bitwiseAND(F.lit(255)) + 1))
    five = F.transform(F.array(*map(F.lit, HALF_BYTES)), lambda mask, i: (i.cast("bigint") + 1) * F.lit(1 << 32) + other.bitwiseAND(mask.cast("bigint")))
    cut = F.when(F.col("n") > crowded, five).when(F.col("n") > hot, byte).otherwise(F.array(F.lit(0).cast("bigint")))
    rows = met.select("k1", F.explode(cut).alias("k2"), "fp")
    rows = rows.repartition(n, "k1", "k2").sortWithinPartitions("k1", "k2", "fp")
    return rows.mapInArrow(_bucket_links(max_bits), "a bigint, b bigint").distinct()


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, label, component): the smallest node and the smallest ``rank`` reachable from each node.

    ``nodes``: (node, rank) with distinct nodes; ``edges``: (a, b).  Each round
    every edge's end with the larger label hands its old label the smaller one
    (labels are themselves nodes), then labels jump to the labels of their
    labels.  Every round's table is written to the shared folder, so the
    lineage stays short and a lost executor only re-reads it."""
    both = materialize(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "simhash-edges")
    touched = both.select(F.col("a").alias("node")).distinct()
    label = materialize(touched.select("node", F.col("node").alias("label")), "simhash-labels")
    while True:
        # smallest neighbour's label, offered to the node and to the node's present label
        seen = both.join(label, both.a == label.node).select(F.col("b").alias("node"), F.col("label").alias("offer"))
        best = seen.groupBy("node").agg(F.min("offer").alias("offer"))
        step = label.join(best, "node").select("node", "label", F.least("label", "offer").alias("offer"))
        hook = step.groupBy("label").agg(F.min("offer").alias("hook")).withColumnRenamed("label", "node")
        new = step.join(hook, "node", "left").select(
            "node", F.col("label").alias("old"), F.least("offer", F.coalesce("hook", "offer")).alias("label"))
        jump = new.select(F.col("node").alias("label"), F.col("label").alias("up"))
        new = materialize(new.join(jump, "label").select("node", "old", F.least("label", "up").alias("label")), "simhash-labels")
        if new.filter("label < old").isEmpty():
            break
        label = new.select("node", "label")
    found = nodes.join(label, "node", "left").select("node", "rank", F.coalesce("label", "node").alias("label"))
    smallest = found.groupBy("label").agg(F.min("rank").alias("component"))
    return found.join(smallest, "label").select("node", "label", "component")


def grouped(docs: DataFrame, size: int = 3, max_bits: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, text_key, fp, label, component), one row per input row."""
    fp = materialize(fingerprints(docs, size, seed), "simhash-fp")
    nodes = fp.groupBy(F.col("fp").alias("node")).agg(F.min("doc_id").alias("rank"))
    edges = links(nodes.select(F.col("node").alias("fp")), max_bits)
    return fp.join(components(nodes, edges).withColumnRenamed("node", "fp"), "fp")


def near_duplicates(docs: DataFrame, size: int = 3, max_bits: int = 3, seed: int = 42) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable), one row per input row.

    Null and empty texts have fingerprint zero and are linked like any other.
    A null doc_id keeps its row; it never is the smallest id, so a component of
    null ids alone has a null component_id.  Repeated ids keep all their rows.
    An empty table gives an empty result; other columns are ignored."""
    return grouped(docs, size, max_bits, seed).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        F.col("component").alias("component_id"))


def keep_one(docs: DataFrame, size: int = 3, max_bits: int = 3, seed: int = 42) -> DataFrame:
    """One row of each component, all columns of ``docs``, whatever their names: the row of the smallest
    doc_id (nulls last); of rows that repeat it, the one with the smallest text hash."""
    found = grouped(docs, size, max_bits, seed)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key", "fp"))
    # by label, as one id may be the smallest of several components, or a component have none
    keep = found.groupBy("label").agg(first.alias("k")) \
        .select(F.col("k.doc_id").alias("_id"), F.col("k.text_key").alias("_key"))
    key, n = unused("_text_key", docs.columns), unused("_n", docs.columns)
    rows = docs.withColumn(key, F.xxhash64("text"))
    kept = rows.join(keep, rows["doc_id"].eqNullSafe(keep["_id"]) & (rows[key] == keep["_key"]), "left_semi")
    w = Window.partitionBy("doc_id", key).orderBy(key)
    return kept.withColumn(n, F.row_number().over(w)).filter(F.col(n) == 1).select(*docs.columns)
