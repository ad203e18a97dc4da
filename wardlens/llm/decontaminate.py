"""Benchmark decontamination by suffix arrays of the training words.

The training documents are cut into shards (a few megabytes of text inside one
Arrow batch).  Each shard gets a suffix array over its words; every suffix of
every benchmark item is looked up in it by binary search, which gives all the
places where its first ``window`` words occur, and consecutive places give the
longest verbatim matches.  Documents with a match are then removed.

Words are numbered by the benchmark's vocabulary (0: any other word), so a
suffix array holds only suffixes that begin with enough benchmark words to
match at all; all others are smaller than any match by definition.

The benchmark is a stated query set.  Equal texts are one text with a list of
its items, equal windows one key with a list of their places.  It travels in
blocks cut by the running sum of their bytes (``block_bytes`` and at most one
text more), each broadcast to one pass over the documents; a benchmark larger
than one block takes several passes, which hand on the positions found so far
with each document.  No document is shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wardlens.llm.shared import materialize, pieces, small_batches, text_bytes, unused
from wardlens.llm.words import Words

BLOCK_BYTES = 4 << 20   # text of benchmark items that one pass holds
SHARD_BYTES = 2 << 20   # text of one suffix array
IDS = 1000              # items that one row of a block names
PASSES = 4              # passes before the documents are written and read again


@dataclass
class Block:
    """A block of benchmark items, ready for lookup."""

    codes: np.ndarray      # sorted hashes of the vocabulary
    number: np.ndarray     # word number (from 1) of each hash
    words: Words           # the items' own words; vocabulary word k is words[at[k]]
    at: np.ndarray
    keys: np.ndarray       # distinct looked-up windows: their words' numbers, big-endian, as sorted byte strings
    length: np.ndarray     # words of each: the window, or the whole of a shorter text
    cut: np.ndarray        # window k stands at the places cut[k]:cut[k + 1] of ``text`` and ``place``
    text: np.ndarray       # text (index into ids) of each place
    place: np.ndarray      # word position of each in its text
    ids: list[list[str]]   # items that have each text
    least: int             # fewest words of any match


def build_block(ids: list[list[str]], texts: pa.Array, window: int) -> Block | None:
    """None if no text has a word."""
    w = Words(*text_bytes(texts))
    if not len(w):
        return None
    codes, at, number = np.unique(w.codes(), return_index=True, return_inverse=True)
    number = np.concatenate((number.astype(np.int64) + 1, np.zeros(window, np.int64)))
    sizes = np.diff(w.first)
    many = np.where(sizes > 0, np.maximum(1, sizes - window + 1), 0)
    text = np.repeat(np.arange(len(sizes)), many)
    place = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    length = np.minimum(sizes, window)[text]
    keys = number[(w.first[:-1][text] + place)[:, None] + np.arange(window)]
    keys[np.arange(window) >= length[:, None]] = 0
    keys, first, group = np.unique(keys.astype(">u4").view(f"S{4 * window}").ravel(), return_index=True, return_inverse=True)
    order = np.argsort(group, kind="stable")
    cut = np.searchsorted(group[order], np.arange(len(keys) + 1))
    return Block(codes, np.arange(1, len(codes) + 1), w, at, keys, length[first], cut, text[order], place[order], ids, int(length.min()))


def numbered(w: Words, block: Block) -> np.ndarray:
    """Each word's number in the block's vocabulary, 0 if it isn't there (bytes are compared)."""
    codes = w.codes()
    slot = np.minimum(np.searchsorted(block.codes, codes), len(block.codes) - 1)
    known = np.flatnonzero(block.codes[slot] == codes)
    own = block.at[slot[known]]
    same = w.size[known] == block.words.size[own]
    known, own, at = known[same], own[same], 0
    good, rest = np.ones(len(known), bool), np.arange(len(known))
    while len(rest):  # eight bytes at a time
        good[rest] &= w.chunk(at, known[rest]) == block.words.chunk(at, own[rest])
        at += 1
        rest = rest[w.size[known[rest]] > 8 * at]
    out = np.zeros(len(w), np.int64)
    out[known[good]] = block.number[slot[known[good]]]
    return out


def occurrences(w: Words, block: Block, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(looked-up window, word position) of every occurrence in the shard's words."""
    number = numbered(w, block)
    # words from each position on that are in the vocabulary and in the same text
    stop = number == 0
    end = np.minimum.accumulate(np.where(stop, np.arange(len(w)), len(w))[::-1])[::-1]
    end = np.minimum(end, w.first[1:][w.doc]) if len(w) else end
    run = end - np.arange(len(w))
    suffix = np.flatnonzero(run >= block.least)
    if not len(suffix):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    padded = np.concatenate((number, np.zeros(window, np.int64)))
    keys = padded[suffix[:, None] + np.arange(window)]
    keys[np.arange(window) >= run[suffix][:, None]] = 0
    keys = keys.astype(">u4").view(f"S{4 * window}").ravel()
    order = np.argsort(keys, kind="stable")  # the suffix array, as far as the window
    suffix, keys = suffix[order], keys[order]
    low = np.searchsorted(keys, block.keys, "left")
    top = block.keys.view(np.uint8).reshape(-1, 4 * window).copy()
    top[np.arange(4 * window) >= 4 * block.length[:, None]] = 255
    high = np.searchsorted(keys, top.view(f"S{4 * window}").ravel(), "right")
    many = high - low
    which = np.repeat(np.arange(len(block.keys)), many)
    inside = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    return which, suffix[low[which] + inside]


def _pass(sent, column: str, window: int, names: list[str]):
    """mapInArrow: adds the matches of one block; the last two of ``names`` are words and matches."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: Block | None = sent.value
        for batch in batches:
            for piece, data, off in pieces(batch, column, SHARD_BYTES):
                before = piece.column(names[-1]).to_pylist()
                if block is not None:
                    w = Words(data, off)
                    which, at = occurrences(w, block, window)
                    many = block.cut[which + 1] - block.cut[which]
                    place = np.arange(many.sum()) + np.repeat(block.cut[which] - np.cumsum(many) + many, many)
                    which, at = np.repeat(which, many), np.repeat(at, many)
                    doc = w.doc[at]
                    # occurrences of one text on one diagonal, one after the other, are one match
                    text, shift = block.text[place], at - block.place[place]
                    order = np.lexsort((at, shift, text))
                    doc, text, shift, at, size = doc[order], text[order], shift[order], at[order], block.length[which][order]
                    new = np.ones(len(at), bool)
                    new[1:] = (text[1:] != text[:-1]) | (shift[1:] != shift[:-1]) | (at[1:] != at[:-1] + 1) | (doc[1:] != doc[:-1])
                    begin = np.flatnonzero(new)
                    last = np.append(begin[1:], len(at)) - 1
                    for b, e in zip(begin, last):
                        d = int(doc[b])
                        match = {"item_word": int(at[b] - shift[b]), "doc_word": int(at[b] - w.first[d]), "words": int(at[e] - at[b] + size[e])}
                        before[d] += [{"item": i} | match for i in block.ids[text[b]]]
                    words = np.diff(w.first).astype(np.int64)
                else:
                    words = np.diff(Words(data, off).first).astype(np.int64)
                cols = piece.columns[:-2]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(words), pa.array(before, MATCHES)], names)

    return run


MATCHES = pa.list_(pa.struct([("item", pa.string()), ("item_word", pa.int64()), ("doc_word", pa.int64()), ("words", pa.int64())]))
_DDL = "array<struct<item:string,item_word:bigint,doc_word:bigint,words:bigint>>"


def blocks_of(benchmark: DataFrame, block_bytes: int) -> DataFrame:
    """(block, text, ids), written: each distinct text with the distinct items that have it, at most ``IDS`` of them a
    row; rows are dealt to blocks by the running sum of their bytes in the order of a hash."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("id"), F.coalesce("text", F.lit("")).alias("text")).distinct()
    part = items.withColumn("part", F.floor((F.row_number().over(Window.partitionBy("text").orderBy("id")) - 1) / IDS))
    rows = part.groupBy("text", "part").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    rows = rows.withColumns({"h": F.xxhash64("text", "part"), "size": F.octet_length("text") + F.aggregate("ids", F.lit(0), lambda n, x: n + F.octet_length(x))})
    rows = materialize(rows.withColumn("range", F.shiftright("h", 52)), "decontaminate-items")
    # bytes in earlier ranges of the hash (4096 rows), then within the range
    sums = rows.groupBy("range").agg(F.sum("size").alias("n"))
    sums = sums.select("range", (F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("range")) - F.col("n")).alias("before"))
    within = F.sum("size").over(Window.partitionBy("range").orderBy("h", "text", "part")) - F.col("size")
    dealt = rows.withColumn("within", within).join(F.broadcast(sums), "range")
    block = F.floor((F.col("before") + F.col("within")) / block_bytes).cast("int")
    return materialize(dealt.select(block.alias("block"), "text", "ids"), "decontaminate-blocks")


def find_matches(docs: DataFrame, benchmark: DataFrame, window: int = 10, block_bytes: int = BLOCK_BYTES,
                 text_col: str = "text", names: tuple[str, str] = ("_words", "_found")) -> DataFrame:
    """The columns of ``docs`` plus ``_words`` (words of the text) and ``_found``: every longest
    verbatim match of at least ``window`` words, or of a whole shorter item, as structs (item,
    item_word, doc_word, words), positions counted in words from 0.

    Null texts have no words; items without words match nothing; a null item_id is called
    "null"; rows that repeat an item_id are one item with several texts, equal rows are one row.
    Empty tables give no rows, or rows without matches.  Input columns with one of the two new
    ``names`` give way to them; all others stay, whatever they are called."""
    if window < 1:
        raise ValueError("a window has at least one word")
    spark = docs.sparkSession
    items = blocks_of(benchmark, block_bytes)
    blocks = items.select("block").distinct().orderBy("block").toArrow().column(0).to_pylist()  # one number a block
    taken = {n.lower() for n in names}
    given = small_batches(docs).select(*[c for c in docs.columns if c.lower() not in taken])
    out = given.withColumns({names[0]: F.lit(0).cast("bigint"), names[1]: F.array().cast(_DDL)})
    schema, columns = out.schema, out.columns
    for k, number in enumerate(blocks or [None]):
        rows = items.filter(F.col("block") == number).select("text", "ids").toArrow()  # ``block_bytes`` and one row at most
        sent = spark.sparkContext.broadcast(build_block(rows.column(1).to_pylist(), rows.column(0).combine_chunks(), window))
        out = out.mapInArrow(_pass(sent, text_col, window, columns), schema)
        if k % PASSES == PASSES - 1 and k < len(blocks) - 1:
            out = materialize(out, "decontaminate-pass")
    return out


def report(docs: DataFrame, benchmark: DataFrame, window: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_hit, n_items, items_sha256, contaminated and
    longest (words of its longest match, 0 if none)."""
    found = find_matches(docs.select("doc_id", "text"), benchmark, window, block_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hit, items, digest, longest = [], [], [], []
            for m in b.column(2).to_pylist():
                n = to = 0
                for s, e in sorted((x["doc_word"], x["doc_word"] + x["words"]) for x in m):
                    n += max(0, e - max(s, to))
                    to = max(to, e)
                own = sorted({x["item"] for x in m})
                hit.append(n)
                items.append(len(own))
                digest.append(hashlib.sha256(",".join(own).encode()).hexdigest())
                longest.append(max((x["words"] for x in m), default=0))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(hit, pa.int64()), pa.array(items, pa.int64()), pa.array(digest, pa.string()),
                 pa.array([h > 0 for h in hit], pa.bool_()), pa.array(longest, pa.int64())],
                ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "longest"])

    src = found.select("doc_id", "_words", "_found")
    return src.mapInArrow(run, f"doc_id {dict(src.dtypes)['doc_id']}, n_words bigint, n_hit bigint, n_items bigint, "
                               "items_sha256 string, contaminated boolean, longest bigint")


def remove_affected(docs: DataFrame, benchmark: DataFrame, window: int = 10,
                    block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs`` without any match, all their columns, whatever their names."""
    names = (unused("_words", docs.columns), unused("_found", docs.columns))
    found = find_matches(docs, benchmark, window, block_bytes, names=names)
    return found.filter(F.size(names[1]) == 0).select(*docs.columns)
