"""BPE encoding and decoding with a word lexicon in a minimal acyclic transducer.

The corpus' most frequent words are encoded once and compiled into an acyclic
automaton in which equal suffixes share states.  Every edge carries the number
of words that sort before those reached through it, so the sum along a word's
path is the word's place in the table of id sequences: the transducer's output.
The lexicon is one file in the shared folder; executors fetch it and
memory-map it.  A task looks up each distinct word of a few megabytes of text
by walking all of them through the automaton side by side; words it does not
hold are merged exactly, lowest rank first, then leftmost.

Normaliser, splitter and merges are those that a ``tokenizers`` JSON file of
this kind names: NFC, white-space runs to one space, lower case; contractions,
letter runs, single digits, runs of other characters; byte-level symbols with an
end-of-word suffix.  Special tokens are found in the raw text first.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import os
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlens.llm.quality import Tokens
from wardlens.llm.shared import pieces, small_batches
from wardlens.sources.sinks import file_system, scratch

LEXICON_WORDS = 1 << 16
LEXICON_BYTES = 128       # longest word of the lexicon: with the number of words, the bound of what reaches the driver
PIECE_BYTES = 2 << 20  # text that a task splits and encodes at once
NONE = np.iinfo(np.int32).max
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"  # fixed value: the format's splitter

# the format's byte alphabet: visible Latin-1 characters stand for themselves, other bytes for U+0100 on
_VISIBLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_CHAR = {b: chr(b) for b in _VISIBLE} | {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in _VISIBLE)}


@dataclass
class Vocabulary:
    """Symbols, merges and special tokens of the JSON file at ``path``."""

    first: np.ndarray            # symbol of each byte inside a word
    last: np.ndarray             # symbol of each byte at its end
    pairs: np.ndarray            # sorted (left << 32 | right) of the merges
    rank: np.ndarray
    joined: np.ndarray
    strings: list[bytes]         # token of each id, UTF-8
    special: dict[str, int]
    near: dict = field(default_factory=dict)   # letters newer than Python's Unicode tables

    @classmethod
    def load(cls, path: str) -> "Vocabulary":
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, end = spec["model"]["vocab"], spec["model"]["end_of_word_suffix"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in merges], dtype=np.int64)
        keys, rank = np.unique(keys, return_index=True)
        joined = np.array([vocab[merges[r][0] + merges[r][1]] for r in rank], dtype=np.int32)
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        strings = {i: s for s, i in (vocab | special).items()}
        return cls(np.array([vocab[BYTE_CHAR[b]] for b in range(256)], dtype=np.int32),
                   np.array([vocab[BYTE_CHAR[b] + end] for b in range(256)], dtype=np.int32),
                   keys, rank.astype(np.int32), joined,
                   [strings.get(i, "").encode() for i in range(max(strings) + 1)], special)

    def merge(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank or NONE, merged symbol) of each pair."""
        key = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.rank[at], NONE), self.joined[at]

    def encode_words(self, words: list[bytes]) -> list[np.ndarray]:
        """The exact merges of each word: side by side for words of equal length."""
        out: list = [None] * len(words)
        by: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            by.setdefault(len(w), []).append(i)
        for n, rows in by.items():
            if n > 48:
                for i in rows:
                    out[i] = self.encode_long(words[i])
                continue
            for at in range(0, len(rows), 20_000):
                part = rows[at:at + 20_000]
                raw = np.frombuffer(b"".join(words[i] for i in part), np.uint8).reshape(-1, n)
                ids = self.first[raw]
                ids[:, -1] = self.last[raw[:, -1]]
                size = self._merge_all(ids)
                for i, row, k in zip(part, ids, size):
                    out[i] = row[:k].copy()
        return out

    def _merge_all(self, ids: np.ndarray) -> np.ndarray:
        m, n = ids.shape
        size = np.full(m, n)
        if n == 1:
            return size
        rank, new = self.merge(ids[:, :-1], ids[:, 1:])
        live = np.arange(m)
        place = np.arange(n)
        while True:
            best = rank[live].argmin(axis=1)
            go = rank[live, best] < NONE
            live, best = live[go], best[go]
            if not len(live):
                return size
            ids[live, best] = new[live, best]
            # close the gap behind each merged pair
            src = np.minimum(place + (place > best[:, None]), n - 1)
            ids[live] = np.take_along_axis(ids[live], src, 1)
            rank[live] = np.take_along_axis(rank[live], src[:, :-1].clip(max=n - 2), 1)
            new[live] = np.take_along_axis(new[live], src[:, :-1].clip(max=n - 2), 1)
            size[live] -= 1
            rank[live, np.minimum(size[live] - 1, n - 2)] = NONE  # nothing follows the last symbol
            for side, ok in ((best - 1, best > 0), (best, best < size[live] - 1)):
                i, j = live[ok], side[ok]
                rank[i, j], new[i, j] = self.merge(ids[i, j], ids[i, j + 1])

    def encode_long(self, word: bytes) -> np.ndarray:
        """The same merges for one long word, with a heap over a linked list."""
        ids = [int(self.first[b]) for b in word[:-1]] + [int(self.last[word[-1]])]
        after, before = [*range(1, len(ids)), -1], [*range(-1, len(ids) - 1)]
        rank, new = (x.tolist() for x in self.merge(np.array(ids[:-1], np.int32), np.array(ids[1:], np.int32)))
        heap = [(r, i, ids[i], ids[i + 1], k) for i, (r, k) in enumerate(zip(rank, new)) if r < NONE]
        heapq.heapify(heap)
        while heap:
            _, i, a, b, k = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j], after[i] = k, -1, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y >= 0:
                    r, m = self.merge(np.array([ids[x]]), np.array([ids[y]]))
                    if r[0] < NONE:
                        heapq.heappush(heap, (int(r[0]), x, ids[x], ids[y], int(m[0])))
        return np.array([x for x in ids if x >= 0], dtype=np.int32)

    # ---- splitting -------------------------------------------------------------------------

    def _newer(self, ch: str) -> tuple[str, bool]:
        """(lower case, is a letter or digit run on its own) of a character that Python's Unicode
        tables lack, as the tokenizers library has it."""
        if ch not in self.near:
            from tokenizers import Regex, normalizers, pre_tokenizers
            low = normalizers.Lowercase().normalize_str(ch)
            word = pre_tokenizers.Split(Regex(r"[\p{L}\p{N}]+"), "removed").pre_tokenize_str(low) == []
            self.near[ch] = (low, word)
        return self.near[ch]

    def split(self, text: str) -> list[bytes | int]:
        """Words (as bytes) and special tokens (as ids) of any text, in order."""
        out: list[bytes | int] = []
        marks = "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))
        for part in regex.split(f"({marks})", text) if marks else [text]:
            if part in self.special:
                out.append(self.special[part])
                continue
            part = unicodedata.normalize("NFC", part)
            newer = {c for c in set(part) if c > "՗" and unicodedata.category(c) == "Cn"}
            lower = {ord(c): self._newer(c)[0] for c in newer} | {0x3A3: "σ"}
            part = part.translate(lower).lower() if any(ord(c) in lower for c in set(part)) else part.lower()
            odd = "".join(c for c in newer if not self._newer(c)[1])
            pattern = SPLIT if not odd else SPLIT.replace(r"[\p{L}]", rf"[\p{{L}}--[{odd}]]").replace(
                r"|[\p{N}]|[^\s\p{L}\p{N}]", rf"|[\p{{N}}--[{odd}]]|(?:[^\s\p{{L}}\p{{N}}]|[{odd}])")
            out += [w.encode() for w in regex.findall(pattern, part, regex.V1 if odd else 0)]
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        """The tokens of ``ids`` with one space between, as UTF-8 (the format names no decoder)."""
        return b" ".join([self.strings[i] for i in ids.tolist()])


class Automaton:
    """Minimal acyclic automaton over byte words; ``find`` gives each word's place among all of them."""

    FIELDS = (("edge", np.int64), ("target", np.int32), ("skip", np.int32), ("final", np.uint8), ("cut", np.int64), ("ids", np.int32))

    def __init__(self, **arrays):
        self.__dict__.update(arrays)

    @classmethod
    def compile(cls, entries: dict[bytes, np.ndarray]) -> "Automaton":
        """``entries``: ids by word.  Words are added in sorted order; the states of a finished
        suffix are replaced by an equal registered one."""
        words = sorted(entries)
        register: dict = {}
        states: list[tuple[bool, tuple]] = []   # (final, ((byte, state), ...)) of registered states

        def settle(node: list) -> int:
            key = (node[0], tuple(node[1]))
            if key not in register:
                register[key] = len(states)
                states.append(key)
            return register[key]

        path: list[list] = [[False, []]]  # open states: [final, [(byte, state) ...]]
        before = b""
        for w in words:
            same = len(os.path.commonprefix([before, w]))
            while len(path) > same + 1:
                node = path.pop()
                path[-1][1].append((before[len(path) - 1], settle(node)))
            for _ in w[same:]:
                path.append([False, []])
            path[-1][0] = True
            before = w
        while len(path) > 1:
            node = path.pop()
            path[-1][1].append((before[len(path) - 1], settle(node)))
        top = settle(path[0])
        below = []  # words under each state; children are registered before their parents
        for final, edges in states:
            below.append(int(final) + sum(below[s] for _, s in edges))
        number = np.arange(len(states))
        number[[0, top]] = number[[top, 0]]  # the start is state 0
        rows = []
        for s, (final, edges) in enumerate(states):
            skip = int(final)
            for b, t in edges:
                rows.append((int(number[s]) << 8 | b, int(number[t]), skip))
                skip += below[t]
        rows.sort()
        final = np.zeros(len(states), np.uint8)
        final[number] = [f for f, _ in states]
        seqs = [entries[w] for w in words]
        return cls(edge=np.array([r[0] for r in rows], np.int64), target=np.array([r[1] for r in rows], np.int32),
                   skip=np.array([r[2] for r in rows], np.int32), final=final,
                   cut=np.concatenate(([0], np.cumsum([len(s) for s in seqs]))).astype(np.int64),
                   ids=np.concatenate([*seqs, np.zeros(0, np.int32)]).astype(np.int32))

    def to_bytes(self) -> bytes:
        head = np.array([len(getattr(self, n)) for n, _ in self.FIELDS], dtype=np.int64)
        body = [np.ascontiguousarray(getattr(self, n), t).tobytes() for n, t in self.FIELDS]
        return b"".join([head.tobytes(), *(b + bytes(-len(b) % 8) for b in body)])

    @classmethod
    def mapped(cls, path: str) -> "Automaton":
        """The arrays of the file at ``path``, memory-mapped."""
        raw = np.memmap(path, dtype=np.uint8, mode="r")
        size, at, out = raw[:8 * len(cls.FIELDS)].view(np.int64), 8 * len(cls.FIELDS), {}
        for (name, kind), n in zip(cls.FIELDS, size):
            width = int(n) * np.dtype(kind).itemsize
            out[name] = raw[at:at + width].view(kind)
            at += width + -width % 8
        return cls(**out)

    def find(self, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Place of each word ``data[start:start + size]`` among the lexicon's words, or -1."""
        place = np.full(len(start), -1, np.int64)
        if not len(self.edge):
            return place
        live, state, total, step = np.arange(len(start)), np.zeros(len(start), np.int64), np.zeros(len(start), np.int64), 0
        while len(live):
            key = state << 8 | data[start[live] + step]
            at = np.minimum(np.searchsorted(self.edge, key), len(self.edge) - 1)
            ok = self.edge[at] == key
            live, at, total = live[ok], at[ok], total[ok]
            total = total + self.skip[at]
            state = self.target[at].astype(np.int64)
            step += 1
            done = size[live] == step
            end = done & (self.final[state] == 1)
            place[live[end]] = total[end]
            live, state, total = live[~done], state[~done], total[~done]
        return place


_UPPER = np.arange(256, dtype=np.uint8)
_UPPER[65:91] += 32


class Split(Tokens):
    """Words of texts that hold only ASCII and U+00C0 to U+00FF without the two signs among them;
    the same words that ``Vocabulary.split`` finds, by byte classes."""

    _KIND = np.full(256, 3, np.uint8)           # 0: white space, 1: letters, 2: digits, 3: others
    _KIND[[9, 10, 11, 12, 13, 32]] = 0
    _KIND[97:123] = _KIND[128:] = 1
    _KIND[48:58] = 2

    @staticmethod
    def plain(data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Which of the texts qualify (and hold no start of a special token)."""
        high = data >= 0xC0
        odd = high & (data != 0xC3)
        second = np.zeros(len(data), bool)
        second[1:] = data[:-1] == 0xC3
        odd |= second & ((data == 0x97) | (data == 0xB7))
        odd[:-1] |= (data[:-1] == 60) & (data[1:] == 124)  # <|
        bad = np.zeros(len(data) + 1, np.int64)
        np.cumsum(odd, out=bad[1:])
        return bad[off[1:]] == bad[off[:-1]]

    def __init__(self, data: np.ndarray, off: np.ndarray):
        low = _UPPER[data]
        second = np.zeros(len(data), bool)
        second[1:] = data[:-1] == 0xC3
        low[second & (data >= 0x80) & (data <= 0x9E)] += 32
        self.data = np.concatenate((low, np.zeros(8, np.uint8)))
        kind = self._KIND[low]
        change = np.ones(len(data) + 1, bool)
        change[1:-1] = (kind[1:] != kind[:-1]) | (kind[1:] == 2)
        change[off] = True
        at = np.flatnonzero(change)
        sort = kind[at[:-1]]
        start, size = at[:-1].copy(), np.diff(at)
        # 's 't 'm 'd 're 've 'll: an apostrophe on its own takes the letters' beginning
        quote = np.flatnonzero((sort[:-1] == 3) & (size[:-1] == 1) & (self.data[start[:-1]] == 39) & (sort[1:] == 1))
        text_end = np.zeros(len(data) + 1, bool)
        text_end[off] = True
        quote = quote[~text_end[start[quote + 1]]] if len(quote) else quote
        a, b = self.data[start[quote + 1]], self.data[start[quote + 1] + 1]
        two = ((a == 114) | (a == 118)) & (b == 101) | (a == 108) & (b == 108)
        two &= size[quote + 1] >= 2
        one = (a == 115) | (a == 116) | (a == 109) | (a == 100)
        take = np.where(one, 1, np.where(two, 2, 0))
        size[quote] += take
        start[quote + 1] += take
        size[quote + 1] -= take
        seen = (sort > 0) & (size > 0)
        self.start, self.size = start[seen], size[seen]
        self.first = np.searchsorted(self.start, off)
        self.doc = np.repeat(np.arange(len(off) - 1), np.diff(self.first))
        self.eight = np.ndarray((len(data) + 1,), "<u8", self.data.data, strides=(1,))


def _gather(cut: np.ndarray, ids: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sequences ``which`` one after the other, their lengths)."""
    size = cut[which + 1] - cut[which]
    begin = np.cumsum(size) - size
    return ids[np.repeat(cut[which] - begin, size) + np.arange(size.sum())], size


class Encoder:
    """Encodes batches of texts with a vocabulary and a memory-mapped lexicon."""

    def __init__(self, vocabulary: Vocabulary, lexicon: Automaton):
        self.v, self.lexicon = vocabulary, lexicon

    def ids_of(self, words: list[bytes]) -> list[np.ndarray]:
        size = np.array([len(w) for w in words], dtype=np.int64)
        place = self.lexicon.find(np.frombuffer(b"".join(words), np.uint8), np.cumsum(size) - size, size)
        out: list = [None] * len(words)
        for i in np.flatnonzero(place >= 0):
            out[i] = self.lexicon.ids[self.lexicon.cut[place[i]]:self.lexicon.cut[place[i] + 1]]
        missing = np.flatnonzero(place < 0)
        for i, seq in zip(missing, self.v.encode_words([words[i] for i in missing])):
            out[i] = seq
        return out

    def plain(self, data: np.ndarray, off: np.ndarray) -> list[np.ndarray]:
        """Ids of texts that ``Split.plain`` allows."""
        s = Split(data, off)
        if not len(s):
            return [np.zeros(0, np.int32)] * (len(off) - 1)
        one, kind = s.distinct()
        place = self.lexicon.find(s.data, s.start[one], s.size[one])
        missing = np.flatnonzero(place < 0)
        fresh = self.v.encode_words([s.word(one[i]) for i in missing])
        # one table: the lexicon's sequences, then the fresh ones
        known = np.flatnonzero(place >= 0)
        own, size = _gather(self.lexicon.cut, self.lexicon.ids, place[known])
        length = np.zeros(len(one), np.int64)
        length[known] = size
        length[missing] = [len(x) for x in fresh]
        slot = np.empty(len(one), np.int64)
        slot[np.concatenate((known, missing))] = np.arange(len(one))
        table = np.concatenate([own, *fresh]).astype(np.int32)
        cut = np.concatenate(([0], np.cumsum(np.concatenate((length[known], length[missing])))))
        flat, size = _gather(cut, table, slot[kind])
        ends = np.concatenate(([0], np.cumsum(size)))[s.first]
        return [flat[b:e] for b, e in zip(ends, ends[1:])]

    def encode(self, data: np.ndarray, off: np.ndarray) -> list[np.ndarray]:
        """Ids of each text, as int32 arrays."""
        n = len(off) - 1
        plain = Split.plain(data, off)
        out: list = [None] * n
        keep = np.flatnonzero(plain)
        if len(keep) == n:
            return self.plain(data, off)
        if len(keep):
            part = np.concatenate([data[off[i]:off[i + 1]] for i in keep])
            for i, ids in zip(keep, self.plain(part, np.concatenate(([0], np.cumsum(np.diff(off)[keep]))))):
                out[i] = ids
        for i in np.flatnonzero(~plain):
            words = self.v.split(data[off[i]:off[i + 1]].tobytes().decode())
            kinds = list(dict.fromkeys(w for w in words if isinstance(w, bytes)))
            seq = dict(zip(kinds, self.ids_of(kinds)))
            out[i] = np.concatenate([np.zeros(0, np.int32)] + [seq[w] if isinstance(w, bytes) else np.array([w], np.int32) for w in words])
        return out


def word_counts(docs: DataFrame, vocabulary, text_col: str = "text") -> DataFrame:
    """(word binary, n bigint): occurrences of every word over all rows; summed in each piece before the shuffle."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v: Vocabulary = vocabulary.value
        for b in batches:
            for _, data, off in pieces(b, text_col, PIECE_BYTES):
                plain = Split.plain(data, off)
                keep = np.flatnonzero(plain)
                part = np.concatenate([data[off[i]:off[i + 1]] for i in keep]) if len(keep) < len(plain) and len(keep) else data if len(keep) else data[:0]
                s = Split(part, np.concatenate(([0], np.cumsum(np.diff(off)[keep]))))
                if len(s):
                    one, kind = s.distinct()
                    yield pa.RecordBatch.from_arrays([pa.array([s.word(i) for i in one], pa.binary()), pa.array(np.bincount(kind), pa.int64())], ["word", "n"])
                rest: dict[bytes, int] = {}
                for i in np.flatnonzero(~plain):
                    for w in v.split(data[off[i]:off[i + 1]].tobytes().decode()):
                        if isinstance(w, bytes):
                            rest[w] = rest.get(w, 0) + 1
                if rest:
                    yield pa.RecordBatch.from_arrays([pa.array(list(rest), pa.binary()), pa.array(list(rest.values()), pa.int64())], ["word", "n"])

    return small_batches(docs).select(text_col).mapInArrow(run, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def write_shared(spark: SparkSession, name: str, content: bytes) -> str:
    """Write a file to the shared folder through Hadoop's file system; its path.  ``release_all`` deletes it."""
    path = scratch(spark, "files", name)
    fs, target = file_system(spark, path)
    out = fs.create(target, True)
    out.write(content)
    out.close()
    return path


def encode(docs: DataFrame, vocabulary_path: str, lexicon_words: int = LEXICON_WORDS,
           text_col: str = "text") -> tuple[DataFrame, "Vocabulary"]:
    """(``docs`` plus ``ids`` array<int>, the vocabulary).

    The lexicon holds the ``lexicon_words`` most frequent words (ties by bytes) of all rows that are not longer
    than ``LEXICON_BYTES``; it changes speed only.  A null or empty text has no ids.  An input column ``ids``
    gives way to the new one, as with ``withColumn``; all others stay, whatever their names."""
    spark = docs.sparkSession
    vocabulary = Vocabulary.load(vocabulary_path)
    sent = spark.sparkContext.broadcast(vocabulary)
    counts = word_counts(docs, sent, text_col).filter(F.octet_length("word") <= LEXICON_BYTES)
    top = counts.orderBy(F.desc("n"), "word").limit(lexicon_words)
    words = [bytes(w) for w in top.select("word").toArrow().column(0).to_pylist()]
    lexicon = Automaton.compile(dict(zip(words, vocabulary.encode_words(words))))
    path = write_shared(spark, "lexicon", lexicon.to_bytes())
    spark.sparkContext.addFile(path)
    name = os.path.basename(path)
    src = docs.withColumn("ids", F.array().cast("array<int>"))
    names, at = src.columns, src.columns.index("ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(sent.value, Automaton.mapped(SparkFiles.get(name)))
        for b in batches:
            for piece, data, off in pieces(b, text_col, PIECE_BYTES):
                ids = encoder.encode(data, off)
                cols = list(piece.columns)
                cut = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32)
                cols[at] = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(np.concatenate(ids), pa.int32()))
                yield pa.RecordBatch.from_arrays(cols, names)

    return src.mapInArrow(run, src.schema), vocabulary


def decode(tokens: DataFrame, vocabulary: Vocabulary, ids_col: str = "ids", name: str = "decoded") -> DataFrame:
    """``tokens`` plus ``name``: the text of the ids; null ids give the empty text."""
    sent = tokens.sparkSession.sparkContext.broadcast(vocabulary)
    src = tokens.withColumn(name, F.lit(""))
    names, at, col = src.columns, src.columns.index(name), src.columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 512):
                part = b.slice(k, 512)
                cols = list(part.columns)
                cols[at] = pa.array([sent.value.decode(x.values.to_numpy()).decode() if x.is_valid else "" for x in cols[col]], pa.string())
                yield pa.RecordBatch.from_arrays(cols, names)

    return src.mapInArrow(run, src.schema)


def digests(docs: DataFrame, vocabulary_path: str, lexicon_words: int = LEXICON_WORDS) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (little-endian unsigned 32-bit ids), decoded_sha256; one row per
    input row, null ids and repeated rows included."""
    tokens, vocabulary = encode(docs.select("doc_id", "text"), vocabulary_path, lexicon_words)
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = [x.values.to_numpy() for x in b.column(1)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(x) for x in lists], pa.int64()),
                 pa.array([hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in lists], pa.string()),
                 pa.array([hashlib.sha256(sent.value.decode(x)).hexdigest() for x in lists], pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    src = tokens.select("doc_id", "ids")
    return src.mapInArrow(run, f"doc_id {dict(src.dtypes)['doc_id']}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
