"""Cross-entropy difference of matched target and background bigram models.

Both models count the same n-grams over one shared vocabulary (all words of all
documents) with the same smoothing; the background is every document, the
target those that a rule selects.  For each token w after v

    p(w | v) = (c(v w) + MU p(w)) / (c(v) + MU),  p(w) = (c(w) + ALPHA) / (N + ALPHA V)

and a document's score is its mean loss under the target model minus that under
the background model: lower means closer to the target.

Counting is exact over whole texts.  A task counts the n-grams of some megabytes
of text (a batch), so an n-gram travels once per batch however often it occurs,
and sends them, packed by hash bucket, to the tasks that add them up.  Those
return to each batch the totals of its own n-grams, in its own order.  The batch
then meets its totals and scores its documents.  No key carries more than one
entry per batch, no document list is gathered by n-gram, and nothing but three
numbers (V and the two N) reaches the driver.  The texts are written once, each with
a number of its own, and both passes read that copy, so a batch holds the same rows in
both, also where the input is a shuffle or a task is run again.  A batch is named by a
hash of its content and of its first text's number: totals can only meet the text they
were counted for, and batches of equal texts, however many, are scored one by one.  The
number of buckets follows the bytes of text, so a bucket stays small whatever the input.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlens.llm.shared import materialize, partitions, pieces, small_batches
from wardlens.llm.words import Words, mix

BATCH_BYTES = 7 << 20
BUCKET_TEXT = 8 << 20   # bytes of text a bucket: its packed n-grams are some two or three times as many
MU, ALPHA = 10.0, 0.5
BEGIN = np.uint64(0x5BD1E9955BD1E995)  # stands before a text's first word


def ngrams(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of each word, of the word before it, and of the pair."""
    word = w.codes()
    before = np.empty_like(word)
    before[1:] = word[:-1]
    first = w.first[:-1][np.diff(w.first) > 0]
    before[first] = BEGIN
    return word, before, mix(before * np.uint64(0x9E3779B97F4A7C15) + word)


def pack(counts: np.ndarray) -> bytes:
    """Counts as one byte each; those of 255 or more follow in full."""
    small = np.minimum(counts, 255).astype(np.uint8)
    return small.tobytes() + counts[small == 255].astype(np.uint64).tobytes()


def unpack(raw, n: int) -> np.ndarray:
    small = np.frombuffer(raw, np.uint8, n)
    out = small.astype(np.uint64)
    out[small == 255] = np.frombuffer(raw, np.uint8, offset=n).view(np.uint64)
    return out


def batch_name(data: np.ndarray, off: np.ndarray, place: int) -> int:
    """Of a batch whose first text has the number ``place``: equal batches have names of their own."""
    h = xxhash.xxh3_64(data.tobytes())
    h.update(off.tobytes())
    h.update(np.int64(place).tobytes())
    return int(np.uint64(h.intdigest()).view(np.int64))


def buckets_of(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(order that puts sorted keys bucket by bucket, where each bucket begins and the last one ends)."""
    bucket = ((keys >> np.uint64(20)) % np.uint64(buckets)).astype(np.int32)
    order = np.argsort(bucket, kind="stable")  # keys stay sorted within a bucket
    return order, np.searchsorted(bucket[order], np.arange(buckets + 1))


def _count_rows(buckets: int, batch_bytes: int):
    """mapInArrow (text, target, place) -> (kind, bucket, batch, keys, all, target): packed counts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for piece, data, off in pieces(b, "text", batch_bytes):
                chosen = piece.column("target").to_numpy(zero_copy_only=False).astype(bool)
                w = Words(data, off)
                if not len(w):
                    continue
                name = batch_name(data, off, piece.column("place")[0].as_py())
                word, before, pair = ngrams(w)
                in_target = chosen[w.doc]
                begins = before == BEGIN
                rows: list[list] = [[] for _ in range(6)]
                for kind, keys, extra, in_extra in ((1, word, begins.sum(), (begins & in_target).sum()), (2, pair, 0, 0)):
                    own, at = np.unique(keys, return_inverse=True)
                    every = np.bincount(at, minlength=len(own))
                    target = np.bincount(at[in_target], minlength=len(own))
                    if kind == 1:  # the number of texts, as the count of BEGIN
                        at = np.searchsorted(own, BEGIN)
                        own, every, target = np.insert(own, at, BEGIN), np.insert(every, at, extra), np.insert(target, at, in_extra)
                    order, cut = buckets_of(own, buckets)
                    own, every, target = own[order], every[order], target[order]
                    for k in np.flatnonzero(np.diff(cut)):
                        s = slice(cut[k], cut[k + 1])
                        for col, v in zip(rows, (kind, int(k), name, own[s].tobytes(), pack(every[s]), pack(target[s]))):
                            col.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, (
                    pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()))], ["kind", "bucket", "batch", "keys", "every", "target"])

    return run


def _totals(rows: pa.Table) -> pa.Table:
    """One bucket: totals of every batch's keys in its order, and (batch null) the bucket's sums."""
    keys = [np.frombuffer(x.as_buffer(), np.uint64) for x in rows.column("keys")]
    own, at = np.unique(np.concatenate(keys), return_inverse=True)
    sums = [np.bincount(at, np.concatenate([unpack(x.as_buffer(), len(k)) for x, k in zip(rows.column(c), keys)]), len(own)).astype(np.uint64)
            for c in ("every", "target")]
    cut = np.concatenate(([0], np.cumsum([len(k) for k in keys])))
    kind, bucket = rows.column("kind")[0].as_py(), rows.column("bucket")[0].as_py()
    n = rows.num_rows
    real = own != BEGIN if kind == 1 else np.zeros(len(own), bool)
    back = [[pack(s[at[b:e]]) for b, e in zip(cut, cut[1:])] + [None] for s in sums]
    return pa.table({
        "kind": pa.array([kind] * (n + 1), pa.int32()), "bucket": pa.array([bucket] * (n + 1), pa.int32()),
        "batch": pa.concat_arrays([rows.column("batch").combine_chunks(), pa.nulls(1, pa.int64())]),
        "every": pa.array(back[0], pa.binary()), "target": pa.array(back[1], pa.binary()),
        "words": pa.array([None] * n + [int(real.sum())], pa.int64()),
        "n_every": pa.array([None] * n + [int(sums[0][real].sum())], pa.int64()),
        "n_target": pa.array([None] * n + [int(sums[1][real].sum())], pa.int64())})


def _texts(batch_bytes: int):
    """mapInArrow (doc_id, text, place) -> one row per batch: its name, ids, bytes and offsets."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for piece, data, off in pieces(b, "text", batch_bytes):
                ids = piece.column("doc_id")
                yield pa.RecordBatch.from_arrays(
                    [pa.array([batch_name(data, off, piece.column("place")[0].as_py())], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids),
                     pa.array([data.tobytes()], pa.binary()), pa.array([off.astype(np.int64).tobytes()], pa.binary())],
                    ["batch", "ids", "data", "off"])

    return run


def token_loss(c_pair: np.ndarray, c_before: np.ndarray, c_word: np.ndarray, n: int, vocabulary: int,
               mu: float = MU, alpha: float = ALPHA) -> np.ndarray:
    """Loss of tokens by the counts of their pair, the word before and the word."""
    p = (c_word + alpha) / (n + alpha * vocabulary)
    return -np.log((c_pair + mu * p) / (c_before + mu))


def _batch_counts(totals: pa.Table, kind: int, keys: np.ndarray, buckets: int) -> list[np.ndarray]:
    """Totals of a batch's sorted distinct ``keys`` in their order, for all documents and for the target."""
    order, cut = buckets_of(keys, buckets)
    part = totals.filter(pa.compute.equal(totals.column("kind"), kind))
    place = dict(zip(part.column("bucket").to_pylist(), range(part.num_rows)))
    need = np.flatnonzero(np.diff(cut)).tolist()
    if not place.keys() >= set(need):
        raise RuntimeError("a batch has met no totals: its content changed between two reads of the input")
    out = []
    for col in ("every", "target"):
        counts = np.empty(len(keys))
        counts[order] = np.concatenate([unpack(part.column(col)[place[x]].as_buffer(), cut[x + 1] - cut[x]) for x in need])
        out.append(counts)
    return out


def _score(buckets: int, sizes: tuple[int, int], vocabulary: int, id_type: str):
    def run(texts: pa.Table, totals: pa.Table) -> pa.Table:
        ids, rows = [], [[], [], []]
        for k in range(texts.num_rows):
            data = np.frombuffer(texts.column("data")[k].as_buffer(), np.uint8)
            off = np.frombuffer(texts.column("off")[k].as_buffer(), np.int64)
            w = Words(data, off)
            n = len(off) - 1
            tokens = np.diff(w.first)
            ids.append(texts.column("ids")[k].values)
            rows[0].append(tokens)
            if not len(w):
                rows[1].append(np.zeros(n))
                rows[2].append(np.zeros(n))
                continue
            word, before, pair = ngrams(w)
            doc, w = w.doc, None
            two, at_pair = np.unique(pair, return_inverse=True)
            at_pair, pair = at_pair.astype(np.int32), None
            pairs = _batch_counts(totals, 2, two, buckets)
            one = np.unique(np.append(word, BEGIN))
            at_word, at_before = (np.searchsorted(one, x).astype(np.int32) for x in (word, before))
            word = before = two = None
            words = _batch_counts(totals, 1, one, buckets)
            for col, c2, c1, size in zip(rows[1:], pairs, words, sizes):
                loss = token_loss(c2[at_pair], c1[at_before], c1[at_word], size, vocabulary)
                col.append(np.bincount(doc, loss, n) / np.maximum(tokens, 1))
        if not ids:
            return pa.table({"doc_id": pa.array([], id_type), "n_tokens": pa.array([], pa.int64()),
                             **{c: pa.array([], pa.float64()) for c in ("target_loss", "background_loss", "score")}})
        background, target = np.concatenate(rows[1]), np.concatenate(rows[2])
        return pa.table({"doc_id": pa.concat_arrays(ids), "n_tokens": pa.array(np.concatenate(rows[0]), pa.int64()),
                         "target_loss": target, "background_loss": background, "score": target - background})

    return run


def score(docs: DataFrame, target: Column, buckets: int | None = None, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """doc_id, n_tokens, target_loss, background_loss, score (mean losses per token), one row per input row.

    ``target``: boolean column of the documents that the target model counts (null: no).  Null texts
    are empty; texts without words score 0.  Null and repeated ids keep their rows.  Without any
    target text the target model is the smoothed uniform one; an empty table gives no rows."""
    spark = docs.sparkSession
    src = materialize(small_batches(docs).select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce(target, F.lit(False)).alias("target"),
                                                 F.monotonically_increasing_id().alias("place")), "lm-texts")
    if buckets is None:
        total = src.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        buckets = max(2 * partitions(spark), -(-total // BUCKET_TEXT))
    counted = src.mapInArrow(_count_rows(buckets, batch_bytes), "kind int, bucket int, batch bigint, keys binary, every binary, target binary")
    totals = materialize(counted.groupBy("kind", "bucket").applyInArrow(
        _totals, "kind int, bucket int, batch bigint, every binary, target binary, words bigint, n_every bigint, n_target bigint"), "lm-totals")
    words, every, chosen = totals.filter("batch IS NULL").agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in ("words", "n_every", "n_target"))).first()
    id_type = src.schema["doc_id"].dataType
    texts = src.mapInArrow(_texts(batch_bytes), f"batch bigint, ids array<{id_type.simpleString()}>, data binary, off binary")
    from pyspark.sql.pandas.types import to_arrow_type
    back = totals.filter("batch IS NOT NULL").select("kind", "bucket", "batch", "every", "target")
    return texts.groupBy("batch").cogroup(back.groupBy("batch")).applyInArrow(
        _score(buckets, (every, chosen), words, to_arrow_type(id_type)),
        f"doc_id {id_type.simpleString()}, n_tokens bigint, target_loss double, background_loss double, score double")
