"""Quality classifier: naive Bayes support vectors.

Features are indicators of token unigrams and bigrams, hashed to ``2 ** bits``
slots.  A token is a run of letters, digits and non-ASCII characters, or a run
of other visible characters; case counts.  Each indicator is scaled by its
class log-count ratio, rows are brought to unit length, and a linear model with
hinge loss is fitted by dual coordinate descent.  Margins are turned into
probabilities by a logistic curve fitted on margins of rows that the scoring
model had not seen (cross-fitting).

The fit uses at most ``fit_rows`` labelled documents (those with the smallest hash of
the id: a bounded sample, the documented parameter), gathered in one task; the
model is one weight per slot (1 MB at 18 bits) and is broadcast.  Scoring is one
pass without a shuffle over whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlens.llm.shared import pieces, small_batches, unused
from wardlens.llm.words import Words, mix

FIT_ROWS = 12_000
PIECE_BYTES = 2 << 20  # text whose indicators a task holds at once
BITS = 18

_CLASS = np.full(256, 2, np.uint8)          # 0: white space, 1: word, 2: other visible
_CLASS[[0, 9, 10, 11, 12, 13, 32]] = 0
_CLASS[48:58] = _CLASS[65:91] = _CLASS[97:123] = _CLASS[128:] = 1


class Tokens(Words):
    """Runs of word characters and runs of other visible characters, in their own case."""

    def __init__(self, data: np.ndarray, off: np.ndarray):
        self.data = np.concatenate((data, np.zeros(8, np.uint8)))
        kind = _CLASS[data]
        change = np.ones(len(data) + 1, bool)
        change[1:-1] = kind[1:] != kind[:-1]
        change[off] = True
        at = np.flatnonzero(change)
        seen = kind[at[:-1]] > 0
        self.start, self.size = at[:-1][seen], np.diff(at)[seen]
        self.first = np.searchsorted(self.start, off)
        self.doc = np.repeat(np.arange(len(off) - 1), np.diff(self.first))
        self.eight = np.ndarray((len(data) + 1,), "<u8", self.data.data, strides=(1,))


def features(data: np.ndarray, off: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(text index, slot) of every indicator that is on, sorted, each once."""
    t = Tokens(data, off)
    code = t.codes()
    two = mix(code[:-1] * np.uint64(3) + code[1:])[t.doc[1:] == t.doc[:-1]] if len(t) > 1 else code[:0]
    doc = np.concatenate((t.doc, t.doc[:-1][t.doc[1:] == t.doc[:-1]])).astype(np.int64)
    slot = (np.concatenate((code, two)) >> np.uint64(64 - bits)).astype(np.int64)
    key = np.sort((doc << bits) | slot)
    if len(key):
        key = key[np.append(True, key[1:] != key[:-1])]
    return key >> bits, key & ((1 << bits) - 1)


def log_count_ratio(slots: list[np.ndarray], y: np.ndarray, size: int, alpha: float = 1.0) -> np.ndarray:
    """Naive Bayes log-count ratio of every slot, add-``alpha`` smoothed."""
    side = []
    for label in (1, -1):
        c = np.full(size, alpha)
        for s, v in zip(slots, y):  # a row's indicators are distinct
            if v == label:
                c[s] += 1
        side.append(np.log(c / c.sum()))
    return side[0] - side[1]


def coordinate_descent(slots: list[np.ndarray], y: np.ndarray, scale: np.ndarray, cost: float = 1.0,
                       rounds: int = 12, seed: int = 0) -> tuple[np.ndarray, float]:
    """Weights per slot and bias of the L2-regularised hinge-loss model on rows scaled by
    ``scale`` to unit length, by dual coordinate descent; the smaller class weighs more."""
    w, bias = np.zeros(len(scale)), 0.0
    norm = np.array([1 / max(np.sqrt((scale[s] ** 2).sum()), 1e-12) for s in slots])
    up = {v: cost * len(y) / (2 * max(1, (y == v).sum())) for v in (1, -1)}
    a, order, rng = np.zeros(len(y)), np.arange(len(y)), np.random.default_rng(seed)
    for _ in range(rounds):
        rng.shuffle(order)
        moved = 0.0
        for i in order:
            s = slots[i]
            x = scale[s] * norm[i]
            g = y[i] * (w[s] @ x + bias) - 1
            new = min(max(a[i] - g / (1.0 + (len(s) > 0)), 0.0), up[y[i]])  # |x|^2 is 1, the bias adds 1
            if new != a[i]:
                step = (new - a[i]) * y[i]
                w[s] += step * x
                bias += step
                moved = max(moved, abs(new - a[i]))
                a[i] = new
        if moved < 1e-3:
            break
    return w, bias


def margins(slots: list[np.ndarray], scale: np.ndarray, w: np.ndarray, bias: float) -> np.ndarray:
    return np.array([w[s] @ scale[s] / max(np.sqrt((scale[s] ** 2).sum()), 1e-12) + bias for s in slots])


def logistic(m: np.ndarray, y: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """(slope, shift) of the probability 1 / (1 + exp(-(slope * m + shift))), by Newton steps with
    Platt's smoothed targets."""
    n1, n0 = (y > 0).sum(), (y < 0).sum()
    t = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a * m + b, -30, 30)))
        v = np.maximum(p * (1 - p), 1e-9)
        g = np.array([((p - t) * m).sum() + 1e-6 * a, (p - t).sum()])
        h = np.array([[(v * m * m).sum() + 1e-6, (v * m).sum()], [(v * m).sum(), v.sum() + 1e-6]])
        da, db = np.linalg.solve(h, g)
        step = min(1.0, 4 / max(abs(da), abs(db), 1e-9))
        a, b = a - step * da, b - step * db
        if abs(da) + abs(db) < 1e-8:
            break
    return float(a), float(b)


@dataclass
class Model:
    """score = 1 / (1 + exp(-(slope * margin + shift))); margin = sum of weights / row length + bias."""

    scale: np.ndarray
    weight: np.ndarray
    bias: float
    slope: float
    shift: float
    bits: int

    def scores(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        doc, slot = features(data, off, self.bits)
        n = len(off) - 1
        r = self.scale[slot]
        length = np.sqrt(np.bincount(doc, r * r, n))
        m = np.bincount(doc, self.weight[slot] * r, n) / np.maximum(length, 1e-12) + self.bias
        return 1 / (1 + np.exp(-np.clip(self.slope * m + self.shift, -30, 30)))


def fit_rows(slots: list[np.ndarray], y: np.ndarray, bits: int, folds: int = 3) -> Model:
    """One class only, or no rows: a constant score, the smoothed share of label 1."""
    size = 1 << bits
    if not len(y) or abs(y.sum()) == len(y):
        share = ((y > 0).sum() + 1) / (len(y) + 2)
        return Model(np.zeros(size), np.zeros(size), 0.0, 0.0, float(np.log(share / (1 - share))), bits)
    unseen, fold = np.zeros(len(y)), np.arange(len(y)) % folds
    for k in range(folds):
        own = np.flatnonzero(fold != k)
        part = [slots[i] for i in own]
        r = log_count_ratio(part, y[own], size)
        w, b = coordinate_descent(part, y[own], r)
        rest = np.flatnonzero(fold == k)
        unseen[rest] = margins([slots[i] for i in rest], r, w, b)
    slope, shift = logistic(unseen, y)
    r = log_count_ratio(slots, y, size)
    w, b = coordinate_descent(slots, y, r)
    return Model(r, w, b, slope, shift, bits)


def fit(docs: DataFrame, labels: DataFrame, usable: Column | None = None, rows: int = FIT_ROWS,
        bits: int = BITS) -> Model:
    """Fit on at most ``rows`` labelled documents: of the ``rows`` rows of ``labels`` (doc_id, quality) with the
    smallest hash of the id for which ``usable`` holds, those that ``docs`` has.

    Labels other than 0 and 1 and null ids are left out.  Rows that repeat an id, its label and its text count
    once; an id with several texts or labels counts once for each, and if that makes more than ``rows``, those of
    the smallest hashes of id and text are taken, so never more than ``rows`` reach the task that fits."""
    known = labels.select(F.col("doc_id").alias("_id"), F.col("quality").alias("_y")).filter(
        F.col("_y").isin(0, 1) & F.col("_id").isNotNull())
    if usable is not None:
        known = known.filter(usable)
    sample = known.distinct().orderBy(F.xxhash64("_id"), "_id", "_y").limit(rows)
    own = small_batches(docs).select("doc_id", "text")
    met = own.join(F.broadcast(sample), F.col("doc_id") == F.col("_id")).select("_id", "_y", F.xxhash64("text").alias("_key"))
    chosen = met.distinct().orderBy(F.xxhash64("_id", "_key"), "_id", "_key", "_y").limit(rows)  # at most ``rows`` rows, broadcast
    text = own.join(F.broadcast(chosen), (F.col("doc_id") == F.col("_id")) & (F.xxhash64("text") == F.col("_key"))) \
        .select("_id", "_y", "_key", "text").dropDuplicates(["_id", "_y", "_key"])

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for piece, data, off in pieces(b, "text", PIECE_BYTES):
                doc, slot = features(data, off, bits)
                cut = np.searchsorted(doc, np.arange(len(off)))
                own = [slot[s:e].astype(np.int32).tobytes() for s, e in zip(cut, cut[1:])]
                yield pa.RecordBatch.from_arrays([piece.column("_id"), piece.column("_y"), pa.array(own, pa.binary())], ["_id", "_y", "slots"])

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = sorted((i, v, s) for b in batches for i, v, s in zip(*(c.to_pylist() for c in b.columns)))
        y = np.array([2 * v - 1 for _, v, _ in found], dtype=np.int64)
        m = fit_rows([np.frombuffer(s, np.int32) for _, _, s in found], y, bits)
        yield pa.RecordBatch.from_arrays(
            [pa.array([x.astype(np.float64).tobytes()], pa.binary()) for x in (m.scale, m.weight, np.array([m.bias, m.slope, m.shift]))],
            ["scale", "weight", "rest"])

    got = text.select("_id", "_y", "text").mapInArrow(extract, f"_id {dict(docs.dtypes)['doc_id']}, _y int, slots binary") \
        .repartition(1).mapInArrow(train, "scale binary, weight binary, rest binary").first()
    scale, weight, rest = (np.frombuffer(x) for x in got)
    return Model(scale, weight, *rest.tolist(), bits)


def score(docs: DataFrame, model: Model, text_col: str = "text", name: str = "score") -> DataFrame:
    """The columns of ``docs`` plus ``name``, a double from 0 to 1; a null text is an empty one.

    An input column ``name`` gives way to the new one; all others stay, whatever their names."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    src = small_batches(docs).withColumn(name, F.lit(0.0))
    names, at = src.columns, src.columns.index(name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for piece, data, off in pieces(b, text_col, PIECE_BYTES):
                cols = list(piece.columns)
                cols[at] = pa.array(sent.value.scores(data, off), pa.float64())
                yield pa.RecordBatch.from_arrays(cols, names)

    return src.mapInArrow(run, src.schema)


def fold(id_col: Column) -> Column:
    """crc32 of the id as text, modulo 4."""
    return F.crc32(id_col.cast("string").cast("binary")) % 4


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, rows: int = FIT_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted, one row per input row.

    The labels of fold 2 are never learnt from (held_out; a null id is not held out).
    Empty and null texts get the score of a row without features."""
    model = fit(docs, labels, fold(F.col("_id")) != 2, rows)
    return score(docs.select("doc_id", "text"), model).select(
        "doc_id", F.coalesce(fold(F.col("doc_id")) == 2, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, rows: int = FIT_ROWS) -> DataFrame:
    """The rows of ``docs`` that score ``threshold`` or more, all their columns, whatever their names."""
    model = fit(docs, labels, fold(F.col("_id")) != 2, rows)
    name = unused("_quality", docs.columns)
    return score(docs, model, name=name).filter(F.col(name) >= threshold).select(*docs.columns)
