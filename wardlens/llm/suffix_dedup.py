"""Suffix-array dedup: bytes of repeated strings of ``length`` (200) bytes are removed.

A string of ``length`` bytes is a suffix of a text as far as its first
``length`` bytes; it is repeated if the suffix array over all texts holds a
neighbour that agrees that far.  Sorting every byte's suffix would move
hundreds of bytes per byte of text, so suffixes are reached through anchors:

1. The anchor of a string is the start of that of its ``ANCHOR``-byte pieces
   whose hash is smallest (leftmost of equal ones).  It depends on the string
   alone, so equal strings have equal anchors at equal offsets.  The strings
   with one anchor form a run; a run's bytes are its span.  An anchor stands
   for some fifty suffixes.
2. Anchors are dealt by the hash of their piece.  A piece that occurs at one
   place only has no repeated string.  A span that occurs at two places makes
   all its strings repeated.  Neither ships any text.
3. What is left are spans that share the anchor's piece but differ elsewhere
   (next to the ends of a shared passage, or around an edit).  One copy of
   each is range-partitioned by the bytes that lead from the anchor (Spark
   samples the splitters), and each bucket sorts the suffixes of its spans by
   multikey quicksort: all open groups at once by their next eight-byte
   character, skipping the characters on which a group agrees.  Suffixes that
   stay together for ``length`` bytes are repeated.
   Equal strings share the leading bytes, and equal leading bytes go to the
   same bucket, so no repeat straddles a boundary, with one exception: a
   piece with very many spans (``HOT_SPANS``) would fill one bucket.  Its
   suffixes are dealt one by one, by all their ``length`` bytes and then by a
   hash of their place, so equal ones may fill many buckets; in sorted order a
   repeat has an equal neighbour, and each bucket's first and last suffix are
   compared across the boundaries.

Copies of a whole text are counted, not compared: all their strings are
repeated, and one of them stands for all in steps 1 to 3.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wardlens.llm.shared import materialize, partitions, pieces, small_batches, unused

LENGTH = 200
ANCHOR = 100
HOT_SPANS = 20_000   # spans of one piece beyond which their suffixes are dealt one by one
LEAD = 32            # bytes from the anchor on that the splitters see
WINDOWS = 1 << 20    # suffixes that a bucket sorts at once
PART = 1 << 20       # bytes of one text that are anchored at once

_B = 0x9E3779B97F4A7C15
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS["up"]) < n:
        n = max(n, 1 << 16)
        one = np.ones(1, np.uint64)
        _POWERS["up"] = np.concatenate((one, np.cumprod(np.full(n, _B, np.uint64))))
        _POWERS["down"] = np.concatenate((one, np.cumprod(np.full(n, pow(_B, -1, 1 << 64), np.uint64))))
    return _POWERS["up"], _POWERS["down"]


def piece_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """A hash of every ``size``-byte piece, from prefix sums of a polynomial modulo 2^64."""
    n = len(data)
    up, down = _powers(n)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n], out=total[1:])
    h = (total[size:] - total[:-size]) * down[:n - size + 1]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def anchors(data: np.ndarray, length: int = LENGTH, anchor: int = ANCHOR) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start of the first string, strings, place of the anchor) of each run of one text of at least
    ``length`` bytes."""
    window = length - anchor + 1
    h = piece_hashes(data, anchor)
    m = len(h)
    # the low bits give way to the place, so the minimum names the leftmost of equal pieces
    h = (h & ~np.uint64((1 << 21) - 1)) | np.arange(m, dtype=np.uint64)
    rows = -(-m // window)
    grid = np.full(rows * window, ~np.uint64(0))
    grid[:m] = h
    grid = grid.reshape(rows, window)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    k = m - window + 1
    low = np.minimum(back[:k], ahead[window - 1:window - 1 + k])
    begin = np.flatnonzero(np.append(True, low[1:] != low[:-1]))
    place = (low[begin] & np.uint64((1 << 21) - 1)).astype(np.int64)
    return begin, np.diff(np.append(begin, k)), place


def text_anchors(text: np.ndarray, length: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``anchors`` of a text of any size, part by part (a run cut by a part's end gives two)."""
    found, at, n = [], 0, len(text)
    while n - at >= length:
        part = text[at:at + PART + length - 1]
        b, c, p = anchors(part, length, anchor)
        found.append((b + at, c, p + at))
        at += PART
    if not found:
        return (np.zeros(0, np.int64),) * 3
    return tuple(np.concatenate(x) for x in zip(*found))


def _anchor_rows(length: int, anchor: int):
    """mapInArrow (text_key, text) -> (deal, piece, span, text_key, at, settled): hashes of the anchor's piece and
    of the span with the anchor's place in it, and start << 16 | anchor's place from the start << 8 | strings.

    A span that a batch holds at several places is repeated, wherever else it occurs: its first place
    stands for it under its piece (settled 1), the others (settled 2) are dealt at random, so a passage or
    line that a third of all texts hold sends one row per batch to its piece."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_64_intdigest
        seen: set[int] = set()  # a copy that this task has met says nothing new
        for b in batches:
            for piece, data, off in pieces(b, "text"):
                keys = piece.column("text_key").to_numpy()
                out: list[list] = [[], [], [], []]
                for i in np.flatnonzero(np.diff(off) >= length):
                    if keys[i] in seen:
                        continue
                    seen.add(keys[i])
                    text = data[off[i]:off[i + 1]]
                    begin, count, place = text_anchors(text, length, anchor)
                    raw = text.tobytes()
                    out[0].append(np.fromiter((digest(raw[p:p + anchor]) for p in place.tolist()), np.uint64, len(place)))
                    out[1].append(np.fromiter((digest(raw[s:e], seed=p) for s, e, p in zip(
                        begin.tolist(), (begin + count - 1 + length).tolist(), (place - begin).tolist())), np.uint64, len(begin)))
                    out[2].append(np.full(len(begin), keys[i]))
                    out[3].append(begin << 16 | (place - begin) << 8 | count)
                if out[0]:
                    cols = [np.concatenate(x).view(np.int64) for x in out]
                    order = np.lexsort((cols[1], cols[0]))
                    cols = [c[order] for c in cols]
                    again = (cols[0][1:] == cols[0][:-1]) & (cols[1][1:] == cols[1][:-1])
                    settled = 2 * np.append(False, again)
                    settled[:-1] |= again & (settled[:-1] == 0)
                    deal = np.where(settled == 2, (cols[2] ^ (cols[3] * np.int64(0x2545F4914F6CDD1D))), cols[0])
                    yield pa.RecordBatch.from_arrays([*(pa.array(c) for c in (deal, *cols)), pa.array(settled.astype(np.int32))],
                                                     ["deal", "piece", "span", "text_key", "at", "settled"])

    return run


def multikey_repeats(data: np.ndarray, start: np.ndarray, group: np.ndarray, length: int) -> np.ndarray:
    """Which of the suffixes ``data[start:]`` agree for ``length`` bytes with another one of their group.

    Multikey quicksort on eight-byte characters: every open group is sorted by the first
    character on which its suffixes differ; groups of one are closed, groups that agree on all
    characters are repeats."""
    chars = -(-length // 8)
    eight = np.ndarray((len(data) - 7,), ">u8", data.data, strides=(1,))
    mask = ~np.uint64(0) << np.uint64(8 * (8 * chars - length))  # of the last character
    repeated = np.zeros(len(start), bool)

    def char(at: int, of: np.ndarray) -> np.ndarray:
        c = eight[start[of] + 8 * at].astype(np.uint64)
        return c & mask if at == chars - 1 else c

    order = np.argsort(group, kind="stable")
    run = group[order]
    while len(order):
        new = np.append(True, run[1:] != run[:-1])
        begin = np.flatnonzero(new)
        size = np.diff(np.append(begin, len(order)))
        keep = np.repeat(size > 1, size)
        order, size = order[keep], size[size > 1]
        if not len(order):
            break
        begin = np.cumsum(size) - size
        number = np.repeat(np.arange(len(size)), size)
        lead = order[begin][number]
        # first character on which each suffix differs from its group's first one
        differ, open_ = np.full(len(order), chars), np.arange(len(order))
        for c in range(chars):
            off = char(c, order[open_]) != char(c, lead[open_])
            differ[open_[off]] = c
            open_ = open_[~off]
            if not len(open_):
                break
        least = np.minimum.reduceat(differ, begin)
        closed = least[number] == chars
        repeated[order[closed]] = True
        order, number, least = order[~closed], number[~closed], least[number][~closed]
        if not len(order):
            break
        key = eight[start[order] + 8 * least].astype(np.uint64)
        key = np.where(least == chars - 1, key & mask, key)
        by = np.lexsort((key, number))
        order, number, key = order[by], number[by], key[by]
        run = np.cumsum(np.append(False, (number[1:] != number[:-1]) | (key[1:] != key[:-1])))
    return repeated


def _merge(begin: np.ndarray, end: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs covered by the ranges."""
    out: list[list[int]] = []
    for b, e in sorted(zip(begin.tolist(), end.tolist())):
        if out and b <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([b, e])
    return [(b, e) for b, e in out]


def _spans(text_at: int, reps_at: int, length: int, hot: int):
    """mapInArrow over rows with a text and its representative spans, the columns of these numbers: the shipped
    spans (lead, piece, span, first, place, body); ``place`` is the anchor's place in the span.  A span of a hot
    piece is shipped as its suffixes: ``lead`` is the suffix, ``first`` its place in the span, ``place`` -1."""
    def cut(raw: bytes, r: dict) -> Iterator[tuple]:
        begin, place, count = r["at"] >> 16, r["at"] >> 8 & 255, r["at"] & 255
        anchor = begin + place
        if r["spans"] <= hot:
            yield raw[anchor:anchor + LEAD], r["piece"], r["span"], 0, place, raw[begin:begin + count - 1 + length]
            return
        for k in range(count):
            yield raw[begin + k:begin + k + length], r["piece"], r["span"], k, -1, b""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, held = [], 0
            for text, reps in zip(b.column(text_at), b.column(reps_at).to_pylist()):
                raw = text.as_buffer().to_pybytes()
                for r in reps:
                    own = list(cut(raw, r))
                    rows += own
                    held += 2 * length * len(own)
                if held > 4 << 20:
                    yield _span_batch(rows)
                    rows, held = [], 0
            if rows:
                yield _span_batch(rows)

    return run


_SPAN_TYPES = (pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())


def _span_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _SPAN_TYPES)],
                                      ["lead", "piece", "span", "first", "place", "body"])


def _buckets(length: int):
    """mapInArrow over spans sorted by (lead, piece, tie, span, first): (piece, span, b, e, edge), the bytes that repeated
    strings cover, counted from the span's start.  All strings of a span hold its anchor, so they cover one range.
    Rows with ``edge`` are the bucket's first and last suffix of a hot piece, to be compared with other buckets'."""
    def solve(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        data = np.frombuffer(b"".join(r[5] for r in rows) + bytes(8), np.uint8)
        size = np.array([len(r[5]) for r in rows])
        at = np.cumsum(size) - size
        count = size - length + 1
        number = np.repeat(np.arange(len(rows)), count)
        step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        lead = np.cumsum([False, *(x[:2] != y[:2] for x, y in zip(rows, rows[1:]))])
        place = np.array([r[4] for r in rows])
        hit = multikey_repeats(data, at[number] + step, lead[number] << 9 | (place[number] - step), length)
        own, step = number[hit], step[hit]
        new = np.append(True, own[1:] != own[:-1]) if len(own) else np.zeros(0, bool)
        begin = np.flatnonzero(new)
        if len(begin):
            end = np.append(begin[1:], len(own)) - 1
            row = own[begin]
            first = np.array([r[3] for r in rows])[row]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.array([r[k] for r in rows])[row], pa.int64()) for k in (1, 2)]
                + [pa.array(first + step[begin], pa.int64()), pa.array(first + step[end] + length, pa.int64()), pa.nulls(len(begin), pa.binary())],
                NAMES)

    def single(rows: list[tuple], edge: bool = False) -> pa.RecordBatch:
        """Suffixes of hot pieces."""
        cols = [[r[1] for r in rows], [r[2] for r in rows], [r[3] for r in rows], [r[3] + length for r in rows]]
        return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols), pa.array([r[0] if edge else None for r in rows], pa.binary())], NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held = 0
        first, last, told, found = None, None, False, []  # of suffixes of hot pieces; ``told``: the last one is found
        for b in batches:
            for r in zip(*(c.to_pylist() for c in b.columns)):
                if r[4] < 0:
                    if last and r[:4] == last[:4]:
                        continue
                    same = last is not None and r[:2] == last[:2]
                    if same:
                        found += [r] if told else [last, r]
                    first, last, told = first or r, r, same
                    if len(found) > 4096:
                        yield single(found)
                        found = []
                    continue
                if rows and r[:2] != rows[-1][:2] and held > WINDOWS:  # groups stay whole: HOT_SPANS spans at most
                    yield from solve(rows)
                    rows, held = [], 0
                if rows and r[:5] == rows[-1][:5]:
                    continue
                rows.append(r)
                held += len(r[5]) - length + 1
        if rows:
            yield from solve(rows)
        if found:
            yield single(found)
        if first:
            yield single([first, last], edge=True)

    return run


NAMES = ["piece", "span", "b", "e", "edge"]
_RUNS = "array<struct<b:bigint,e:bigint>>"


def repeated_runs(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, hot: int = HOT_SPANS) -> DataFrame:
    """The columns of ``docs`` plus, last, ``_runs`` (underscores are added if ``docs`` has it): byte ranges (b, e) of the UTF-8 text that strings of
    ``length`` bytes cover which start at any other place of any text too (they may overlap).

    Null texts are empty and have none; so have texts shorter than ``length``.  Rows may repeat,
    ids may be null: copies are rows with equal texts (equal 64-bit hashes, CRC and length)."""
    if not 0 < anchor <= length or length - anchor > 254:
        raise ValueError("anchor must be at most length, and at least length - 254")
    spark = docs.sparkSession
    n = partitions(spark)
    key, row = F.xxhash64(F.lit(length), "text"), F.xxhash64("doc_id")
    # columns beside those of ``docs``, whatever these are called
    own_key, own_row, k, r, reps, runs = (unused(c, docs.columns) for c in ("_key", "_row", "_k", "_r", "_reps", "_runs"))
    small_batches(docs)
    # copies: texts that occur in several rows, and the row that stands for a text
    raw = F.col("text").cast("binary")
    rows = materialize(docs.select(key.alias("text_key"), row.alias("row"), F.crc32(raw).alias("crc"), F.length(raw).alias("size"))
                       .filter(F.col("size") >= length), "suffix-texts")
    # written, so that its joins read it from an exchange of its own: Spark splits the hot side of such joins
    texts = materialize(rows.groupBy("text_key", "crc", "size").agg(F.count(F.lit(1)).alias("copies"), F.min("row").alias("row")), "suffix-distinct")

    # steps 1 and 2: anchors by piece; sorted, so neighbours tell what occurs once
    found = docs.select(key.alias("text_key"), "text").mapInArrow(
        _anchor_rows(length, anchor), "deal bigint, piece bigint, span bigint, text_key bigint, at bigint, settled int").repartition(n, "deal")
    group = Window.partitionBy("deal", "piece")
    by = group.orderBy("span", "text_key", "at", "settled")
    # copies of a text give one place several times: the last such row has the strongest mark and stays
    met = found.withColumns({"_p": F.lag("span").over(by), "_n": F.lead(F.struct("span", "text_key", "at")).over(by)}) \
        .filter("_p IS NOT NULL OR _n IS NOT NULL OR settled > 0") \
        .filter(F.col("_n").isNull() | (F.col("_n") != F.struct("span", "text_key", "at"))) \
        .withColumn("first", (F.row_number().over(Window.partitionBy("deal", "piece", "span").orderBy("text_key", "at")) == 1) & (F.col("settled") < 2))
    met = met.withColumns({"places": F.count(F.lit(1)).over(group), "spans": F.sum(F.col("first").cast("long")).over(group),
                           "same": (F.count(F.lit(1)).over(Window.partitionBy("deal", "piece", "span")) > 1)
                           | (F.max("settled").over(Window.partitionBy("deal", "piece", "span")) > 0)}).filter("places > 1 OR same")
    met = materialize(met.select("piece", "span", "text_key", "at", "first", "spans", "same"), "suffix-anchors")

    # step 3: one copy of each span of a piece that has several
    wanted = met.filter("first AND spans > 1").groupBy("text_key").agg(
        F.collect_list(F.struct("piece", "span", "spans", "at")).alias("reps"))
    wanted = wanted.join(texts.select("text_key", "row"), "text_key").select(F.col("text_key").alias(k), F.col("row").alias(r), F.col("reps").alias(reps))
    # the texts are dealt once for this join and the last one (all columns go along, so Spark reuses the exchange)
    dealt = docs.withColumns({own_key: key, own_row: row}).repartition(n, own_key, own_row)
    body = dealt.join(wanted, (F.col(own_key) == F.col(k)) & (F.col(own_row) == F.col(r))).drop(k, r)
    body = body.withColumn("text", raw)
    spans = body.mapInArrow(_spans(body.columns.index("text"), body.columns.index(reps), length, hot), "lead binary, piece bigint, span bigint, first int, place int, body binary")
    # a suffix of a hot piece has its place as a tie, so equal ones are dealt to several buckets
    tie = F.when(F.col("place") < 0, F.xxhash64("span", "first")).otherwise(F.lit(0).cast("bigint"))
    by = ["lead", "piece", "tie", "span", "first"]
    solved = spans.withColumn("tie", tie).repartitionByRange(n, "lead", "piece", "tie").sortWithinPartitions(*by).drop("tie").mapInArrow(
        _buckets(length), "piece bigint, span bigint, b bigint, e bigint, edge binary")
    solved = materialize(solved, "suffix-solved")
    across = solved.filter("edge IS NOT NULL").groupBy("edge").agg(F.collect_set(F.struct("piece", "span", "b", "e")).alias("x"))  # two rows a bucket
    across = across.filter(F.size("x") > 1).select(F.inline("x"))
    solved = solved.filter("edge IS NULL").drop("edge").union(across).groupBy("piece", "span").agg(F.min("b").alias("b"), F.max("e").alias("e"))

    # back to the texts: ranges of every place of a span, for every text that is no copy
    start, count = F.shiftright("at", 16), F.col("at").bitwiseAND(F.lit(255))
    whole = met.filter("same").select("text_key", start.alias("b"), (start + count + (length - 1)).alias("e"))
    part = met.filter("NOT same").join(solved, ["piece", "span"]).select("text_key", (F.col("b") + start).alias("b"), (F.col("e") + start).alias("e"))
    ranges = whole.union(part).join(texts.filter("copies = 1").select("text_key", "row"), "text_key").groupBy("text_key", "row").agg(
        F.collect_list(F.struct("b", "e")).alias("_runs"))
    copies = rows.join(texts.filter("copies > 1").select("text_key", "crc", "size"), ["text_key", "crc", "size"]).select(
        "text_key", "row", F.array(F.struct(F.lit(0).cast("bigint").alias("b"), F.col("size").cast("bigint").alias("e"))).alias("_runs")).distinct()
    told = ranges.union(copies).select(F.col("text_key").alias(k), F.col("row").alias(r), F.col("_runs").alias(runs))
    out = dealt.join(told, (F.col(own_key) == F.col(k)) & (F.col(own_row) == F.col(r)), "left")
    return out.select(*docs.columns, F.coalesce(runs, F.array().cast(_RUNS)).alias(runs))


def _ranges(runs) -> list[tuple[int, int]]:
    return _merge(np.array([r["b"] for r in runs], np.int64), np.array([r["e"] for r in runs], np.int64)) if runs else []


def report(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, one row per input row."""
    found = repeated_runs(docs.select("doc_id", "text"), length)
    src = found.select("doc_id", F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"), "_runs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, gone, spans, digest = [], [], [], []
            for text, runs in zip(b.column(1), b.column(2).to_pylist()):
                raw = memoryview(text.as_buffer())
                runs, at, h = _ranges(runs), 0, hashlib.sha256()
                for s, e in runs:
                    h.update(raw[at:s])
                    at = e
                h.update(raw[at:])
                size.append(len(raw))
                gone.append(sum(e - s for s, e in runs))
                spans.append(len(runs))
                digest.append(h.hexdigest())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array(x, pa.int64()) for x in (size, gone, spans)), pa.array(digest, pa.string())],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return src.mapInArrow(run, f"doc_id {dict(src.dtypes)['doc_id']}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``docs`` with the repeated bytes taken out of ``text`` (and ``n_chars``, if there, counted anew).

    A character that a range covers in part stays, so texts stay valid UTF-8; null texts stay null."""
    found = repeated_runs(docs, length)
    names = docs.columns
    at = names.index("text")
    chars = names.index("n_chars") if "n_chars" in names else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = list(b.columns)
            texts, counts = [], []
            for text, runs in zip(cols[at], cols[-1].to_pylist()):
                raw, kept, last = (text.as_py().encode() if text.is_valid else None), [], 0
                for s, e in _ranges(runs) if raw is not None else ():
                    while s < e and raw[s] & 0xC0 == 0x80:
                        s += 1
                    while e > s and e < len(raw) and raw[e] & 0xC0 == 0x80:
                        e -= 1
                    kept.append(raw[last:s])
                    last = e
                whole = None if raw is None else b"".join([*kept, raw[last:]]).decode()
                texts.append(whole)
                counts.append(None if whole is None else len(whole))
            cols[at] = pa.array(texts, pa.string())
            if chars is not None:
                cols[chars] = pa.array([c if t is not None else old for c, t, old in zip(counts, texts, cols[chars].to_pylist())], cols[chars].type)
            yield pa.RecordBatch.from_arrays(cols[:-1], names)

    return found.mapInArrow(run, docs.schema)
