"""Periodic run detection: recursive frequency splitting, then a scan of every lag.

A run is a stretch of consecutive words with smallest period q (words q apart
are equal) and length >= max(least, 2 * q) that no neighbouring word extends.

* Splitting.  A run holds each of its words at least twice, so a word that
  occurs once in a segment belongs to no run and cuts it; pieces shorter than
  ``least`` go.  The pieces are counted anew until none holds such a word.
  All segments of a batch are counted by one sort a round, and a segment that
  lost no word is not counted again.
* Lag scan.  Words q apart are equal all along a run but its last q words, so
  equal words stand at some multiple of q (counted from the segment's start)
  for every run of period q: a segment of m words takes about m * ln(m) probes
  for all lags up to m / 2.  A probe whose neighbours are equal too is extended
  to both sides by binary search on prefix hashes.  Runs found are compared word
  by word; if a hash has misled, the batch is scanned again with another base.
* A stretch with a smaller period p and length >= 2 * q has p as a divisor of q
  (Fine and Wilf), so it was found at lag p with the same ends: of equal ends
  the smallest lag stays.

Words are maximal runs of bytes other than space and 0x09 to 0x0D.  One pass
over whole texts without a shuffle; arrays hold one piece of ``PIECE_BYTES`` of
text (or one longer text) at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlens.llm.shared import pieces, small_batches, unused
from wardlens.llm.words import Words

LEAST = 12
PIECE_BYTES = 2 << 20
PROBES = 1 << 20  # probes held at once
RUN = "struct<start:bigint,length:bigint,period:bigint>"

_VISIBLE = np.ones(256, bool)
_VISIBLE[[9, 10, 11, 12, 13, 32]] = False
_SAME = np.arange(256, dtype=np.uint8)


def _spans(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """begin[i], begin[i] + 1, ... of each of the ``size`` long spans, one after the other."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(begin - (ends - size), size)


def split(kind: np.ndarray, first: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray]:
    """(begin, end) of the segments in which every word occurs twice, of texts ``kind[first[i]:first[i + 1]]``."""
    begin, end = first[:-1].astype(np.int64), first[1:].astype(np.int64)
    done: list[tuple[np.ndarray, np.ndarray]] = []
    while True:
        long = end - begin >= least
        begin, end = begin[long], end[long]
        if not len(begin):
            break
        size = end - begin
        place, owner = _spans(begin, size), np.repeat(np.arange(len(begin)), size)
        _, which, count = np.unique(owner * (int(kind.max()) + 1) + kind[place], return_inverse=True, return_counts=True)
        rare = count[which] < 2
        hit = np.bincount(owner[rare], minlength=len(begin)) > 0
        done.append((begin[~hit], end[~hit]))
        # what is left of the others: maximal stretches of words that are not rare
        keep = ~rare & hit[owner]
        place, owner = place[keep], owner[keep]
        if not len(place):
            break
        cut = np.flatnonzero((np.diff(place) != 1) | (np.diff(owner) != 0))
        begin = place[np.append(0, cut + 1)]
        end = place[np.append(cut, len(place) - 1)] + 1
    if not done:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([d[0] for d in done]), np.concatenate([d[1] for d in done])


def _probes(begin: np.ndarray, end: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(segment, lag, position) of the probes of all lags, in portions of bounded size.

    A lag q of a segment of m words has (m - 1) // q probes."""
    size = end - begin
    lags = np.cumsum(size // 2)
    total, at = int(lags[-1]) if len(lags) else 0, 0
    while at < total:
        to = min(total, at + PROBES)
        pair = np.arange(at, to)
        seg = np.searchsorted(lags, pair, "right")
        lag = pair - (lags[seg] - size[seg] // 2) + 1
        n = (size[seg] - 1) // lag
        cum = np.cumsum(n)
        fit = max(1, int(np.searchsorted(cum, PROBES, "right")))
        seg, lag, n, at = seg[:fit], lag[:fit], n[:fit], at + min(fit, to - at)
        for a in range(0, int(n.sum()), PROBES):  # one lag may have more probes than a portion holds
            b = min(int(n.sum()), a + PROBES)
            which = np.searchsorted(cum[:fit], np.arange(a, b), "right")
            k = np.arange(a, b) - (cum[which] - n[which])
            yield seg[which], lag[which], begin[seg[which]] + k * lag[which]


def _near(kind: np.ndarray, place: np.ndarray, lag: np.ndarray, lo: np.ndarray, hi: np.ndarray, step_to: int) -> np.ndarray:
    """Whether all words beside ``place`` up to ``step_to`` (left if negative) equal those ``lag`` further on."""
    side = 1 if step_to > 0 else -1
    ok = (place + step_to >= lo) & (place + lag + step_to < hi)
    for step in range(1, abs(step_to) + 1):
        i = np.flatnonzero(ok)
        ok[i] = kind[place[i] + side * step] == kind[place[i] + lag[i] + side * step]
    return ok


def _reach(top: np.ndarray, equal) -> np.ndarray:
    """Largest r <= top for which ``equal(index, r)`` holds; it holds for 0 and fails from some r on."""
    low, high = np.zeros(len(top), np.int64), top.copy()
    while True:
        open_ = np.flatnonzero(low < high)
        if not len(open_):
            return low
        mid = (low[open_] + high[open_] + 1) >> 1
        ok = equal(open_, mid)
        low[open_[ok]] = mid[ok]
        high[open_[~ok]] = mid[~ok] - 1


def _scan(kind: np.ndarray, begin: np.ndarray, end: np.ndarray, least: int, base: int) -> np.ndarray | None:
    """(start, end, lag) of all runs in the segments, or None if a hash has misled."""
    power = np.full(len(kind) + 1, base, np.uint64)
    power[0] = 1
    np.cumprod(power, out=power)
    total = np.zeros(len(kind) + 1, np.uint64)
    np.cumsum((kind.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(base)) * power[:-1], out=total[1:])
    # words equal to those a lag on come at least least / 2 in a row in a run, so half the others lie on one side
    beside = -(-((least + 1) // 2 - 1) // 2)
    found = []
    for seg, lag, place in _probes(begin, end):
        hit = np.flatnonzero(kind[place] == kind[place + lag])
        seg, lag, place = seg[hit], lag[hit], place[hit]
        lo, hi = begin[seg], end[seg]
        near = _near(kind, place, lag, lo, hi, beside) | _near(kind, place, lag, lo, hi, -beside)
        lag, place, lo, hi = lag[near], place[near], lo[near], hi[near]
        if not len(lag):
            continue

        def same(a: np.ndarray, b: np.ndarray, q: np.ndarray) -> np.ndarray:
            return (total[b] - total[a]) * power[q] == total[b + q] - total[a + q]

        right = _reach(hi - lag - place, lambda i, r: same(place[i], place[i] + r, lag[i]))
        left = _reach(place - lo, lambda i, r: same(place[i] - r, place[i], lag[i]))
        runs = np.stack((place - left, place + right + lag, lag), axis=1)
        length = runs[:, 1] - runs[:, 0]
        found.append(np.unique(runs[length >= np.maximum(least, 2 * lag)], axis=0))
    if not found:
        return np.zeros((0, 3), np.int64)
    runs = np.unique(np.concatenate(found), axis=0)  # by start, end, lag
    if not len(runs):
        return runs
    new = np.append(True, (np.diff(runs[:, 0]) != 0) | (np.diff(runs[:, 1]) != 0))
    shortest = runs[new]
    if np.any(runs[:, 2] % shortest[np.cumsum(new) - 1, 2]):
        return None
    compare = shortest[:, 1] - shortest[:, 0] - shortest[:, 2]
    for a in range(0, len(shortest), 1024):
        part, n = shortest[a:a + 1024], compare[a:a + 1024]
        i = _spans(part[:, 0], n)
        if np.any(kind[i] != kind[i + np.repeat(part[:, 2], n)]):
            return None
    return shortest


def find(kind: np.ndarray, first: np.ndarray, least: int = LEAST) -> np.ndarray:
    """Rows (start, end, period) of all runs, by start then period; positions count through all texts."""
    begin, end = split(kind, first, least)
    base, runs = 0xD6E8FEB86659FD93, None
    while runs is None:
        runs, base = _scan(kind, begin, end, least, base), base + 0x632BE59BD9B4E018 & (1 << 64) - 1
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def collapse(w: Words, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of the texts without the words that follow a run's first period, one space between words."""
    drop = np.zeros(len(w) + 1, np.int64)
    np.add.at(drop, runs[:, 0] + runs[:, 2], 1)
    np.add.at(drop, runs[:, 1], -1)
    kept = np.flatnonzero(np.cumsum(drop[:-1]) == 0)
    n = len(w.data) - 8
    last = np.append(w.doc[kept][1:] != w.doc[kept][:-1], True) if len(kept) else np.zeros(0, bool)
    # a word that is not its text's last is followed by white space in the text itself
    mark = np.zeros(n + 1, np.int8)
    mark[w.start[kept]] += 1
    mark[w.start[kept] + w.size[kept] + ~last] -= 1
    take = np.cumsum(mark[:n], dtype=np.int8) > 0
    data = w.data[:n].copy()
    data[~_VISIBLE[data]] = 32
    return data[take], np.concatenate(([0], np.cumsum(take)))


def collapse_runs(docs: DataFrame, least: int = LEAST, text_col: str = "text") -> DataFrame:
    """``docs`` plus ``n_words``, ``runs`` (array of start, length, period by start then period; start is a
    word number from 0) and ``collapsed``: the words that no run holds after its first period, one space between.

    One row per input row, repeated rows and null ids included; an empty table gives an empty one.  A null, empty
    or blank text has no words, no runs and the empty collapsed text.  Overlapping runs, and runs with equal
    start and different periods, are all reported.  Input columns with one of the three new names give way to
    the new ones, as with ``withColumn``; all others stay as they are, whatever their names."""
    given = small_batches(docs).select(*[c for c in docs.columns if c.lower() not in ("n_words", "runs", "collapsed")])
    src = given.withColumns({"n_words": F.lit(0).cast("long"), "runs": F.array().cast(f"array<{RUN}>"), "collapsed": F.lit("")})
    names, kept = src.columns, len(given.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece, data, off in pieces(batch, text_col, PIECE_BYTES):
                w = Words(data, off, _VISIBLE, _SAME)
                _, kind = w.distinct()
                runs = find(kind.astype(np.int64), w.first, least)
                body, at = collapse(w, runs)
                owner = w.doc[runs[:, 0]]
                cut = np.searchsorted(owner, np.arange(piece.num_rows + 1)).astype(np.int32)
                spans = pa.StructArray.from_arrays(
                    [pa.array(runs[:, 0] - w.first[owner]), pa.array(runs[:, 1] - runs[:, 0]), pa.array(runs[:, 2])],
                    ["start", "length", "period"])
                text = pa.Array.from_buffers(pa.large_string(), piece.num_rows,
                                             [None, pa.py_buffer(at[off].astype(np.int64)), pa.py_buffer(body)])
                yield pa.RecordBatch.from_arrays(
                    [*piece.columns[:kept], pa.array(np.diff(w.first).astype(np.int64)),
                     pa.ListArray.from_arrays(pa.array(cut), spans), text.cast(pa.string())], names)

    return src.mapInArrow(run, src.schema)


def plant(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with a periodic tail in the texts of every tenth id hash (the fixed rule of the registered query).

    h is the crc32 of the decimal id; where h % 10 = 0 the word i >= a becomes word a + (i - a) % p with
    g = h div 10, a = g % n, p = 1 + (n - a) div (3 + g % 8).  A null id or a text without words stays as it is."""
    w = unused("given", docs.columns)
    h = F.crc32(F.col(id_col).cast("string").cast("binary"))
    given = F.filter(F.split(text_col, "[ \\t-\\r]+"), lambda x: x != "")
    found = docs.withColumn(w, F.when(h % 10 == 0, F.struct(given.alias("words"), F.size(given).cast("long").alias("n"), h.alias("h"))))
    tail = F.expr(f"""transform(sequence(0L, {w}.n - 1), i -> {w}.words[cast(if(i >= {w}.h div 10 % {w}.n,
        {w}.h div 10 % {w}.n + (i - {w}.h div 10 % {w}.n) % (1 + ({w}.n - {w}.h div 10 % {w}.n) div (3 + {w}.h div 10 % 8)), i) as int)])""")
    return found.withColumn(text_col, F.when(F.col(w)["n"] > 0, F.array_join(tail, " ")).otherwise(F.col(text_col))).drop(w)


def digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """doc_id, n_runs, the longest run (ties: smallest start, then period; nulls without runs) and the two digests
    of what ``collapse_runs`` returned; n_words beside them."""
    top = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("back"), (-r["period"]).alias("less"))))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    return found.select(id_col, "n_words", "collapsed", lines.alias("lines"), top.alias("top")).select(
        F.col(id_col), F.size("lines").cast("long").alias("n_runs"), (-F.col("top.back")).alias("start"), F.col("top.length").alias("length"),
        (-F.col("top.less")).alias("period"), F.expr("1000 * top.length div -top.less").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("lines", lambda x: F.concat(x, F.lit("\n"))), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"), "n_words")


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
             xor(list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT)),
               lambda crc, byte: list_reduce(range(8), lambda x, k: xor(x >> 1, 3988292384 * (x & 1)), xor(crc, byte)), CAST(4294967295 AS BIGINT)), 4294967295) AS h
           FROM documents),
plan AS (SELECT r, w, len(w) AS n, coalesce(h % 10 = 0, false) AS planted, h // 10 % len(w) AS a, h // 10 AS g FROM d WHERE len(w) > 0),
t AS (SELECT r, n, i, w[1 + CASE WHEN planted AND i >= a THEN a + (i - a) % (1 + (n - a) // (3 + g % 8)) ELSE i END] AS word
      FROM (SELECT *, unnest(range(n)) AS i FROM plan)),
pairs AS (SELECT x.r, y.i - x.i AS q, x.i FROM t x JOIN t y ON x.r = y.r AND x.word = y.word AND x.i < y.i AND 2 * (y.i - x.i) <= x.n),
numbered AS (SELECT r, q, i, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS run FROM pairs),
stretches AS (SELECT r, q, min(i) AS start, count(*) + q AS length FROM numbered GROUP BY r, q, run HAVING count(*) >= greatest(12 - q, q)),
runs AS (SELECT r, start, length, min(q) AS period FROM stretches GROUP BY r, start, length),
per AS (SELECT r, count(*) AS n_runs, string_agg(concat(start, ',', length, ',', period, chr(10)), '' ORDER BY start, period) AS lines,
          first(struct_pack(s := start, l := length, p := period) ORDER BY length DESC, start, period) AS top FROM runs GROUP BY r),
gone AS (SELECT DISTINCT r, unnest(range(start + period, start + length)) AS i FROM runs),
kept AS (SELECT r, string_agg(word, ' ' ORDER BY i) AS body FROM t ANTI JOIN gone USING (r, i) GROUP BY r)
SELECT doc_id, CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs, CAST(top.s AS BIGINT) AS start, CAST(top.l AS BIGINT) AS length,
       CAST(top.p AS BIGINT) AS period, CAST(1000 * top.l // top.p AS BIGINT) AS exponent_milli,
       sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(body, '')) AS collapsed_sha256, CAST(len(w) AS BIGINT) AS n_words
FROM d LEFT JOIN per USING (r) LEFT JOIN kept USING (r)
"""
