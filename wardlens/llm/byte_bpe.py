"""Byte-level BPE encoding and decoding through a serialised sentencepiece model.

A rank file gives a token's bytes and its rank; merging the adjacent pair whose
joined bytes have the lowest rank, leftmost first, until none is a token, is BPE.  A
sentencepiece BPE model merges the adjacent pair whose joined piece has the highest
score, leftmost first.  So a model with one piece per token, its bytes written as the
byte alphabet's characters and scored by the negative rank, encodes alike once it
neither normalises nor adds anything: identity normaliser, no prefix, white space as
it is.  Piece number and rank are the same, numbers without a token are unused pieces.

The model is written directly in its wire format from the vocabulary, about a
megabyte, and sent to every task.  A text is split by the pattern; every distinct
pre-token goes through the model once per cache filling, a pre-token that is itself a
token has that id at once.  Decoding maps the pieces' characters back to bytes.

The pattern's character classes are those of the rank file's library.  Characters whose
class differs in Python's tables (newer ones) are replaced by one of the right
class while a text is split, one for one, so places stay the same.

One pass without a shuffle; a task holds ``PIECE_BYTES`` of text (or one longer
text) and at most ``CACHED`` pre-tokens at a time.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlens.llm.bpe import BYTE_CHAR, _gather
from wardlens.llm.shared import pieces, small_batches

PIECE_BYTES = 2 << 20
CACHED = 1 << 17        # pre-tokens kept by a task
CACHED_CHARS = 256      # longer ones are not kept
AT_ONCE = 1 << 16       # pre-tokens of a long text that are split off at once

_CHARS = [BYTE_CHAR[b] for b in range(256)]
_BYTE = {c: b for b, c in enumerate(_CHARS)}
_OUTSIDE = "\ue000"     # no byte's character: names of pieces that no text can give
# a character of each class that a pattern may name; no ASCII one, which patterns may name themselves
_SAMPLE = {r"\p{L}": "é", r"\p{N}": "¼", r"[^\s\p{L}\p{N}]": "¡"}


# ---- the model's wire format -------------------------------------------------------------------


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value: int | float | bytes) -> bytes:
    """One protocol-buffer field: varint, 32-bit float or length-delimited."""
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    return _varint(number << 3) + _varint(value)


# fixed values: field numbers and enumerations of the sentencepiece model format
PIECE, TRAINER, NORMALIZER = 1, 2, 3
PIECE_TEXT, PIECE_SCORE, PIECE_KIND = 1, 2, 3
NORMAL, UNKNOWN, UNUSED = 1, 2, 5
TRAINER_MODEL, TRAINER_SIZE, TRAINER_UNKNOWN, BPE = 3, 4, 40, 2
NORMALIZER_NAME, ADD_PREFIX, REMOVE_SPACES, ESCAPE_SPACES = 1, 3, 4, 5


def serialise(tokens: list[bytes | None]) -> bytes:
    """The BPE model whose piece i is ``tokens[i]`` (None: no such id); one more piece stands for the unknown."""
    if len(tokens) >= 1 << 24:
        raise ValueError("scores are single-precision numbers: ranks beyond 2 ** 24 would tie")
    out = []
    for rank, token in enumerate(tokens):
        name = f"{_OUTSIDE}{rank}" if token is None else "".join(_CHARS[b] for b in token)
        out.append(_field(PIECE, _field(PIECE_TEXT, name.encode()) + _field(PIECE_SCORE, float(-rank))
                          + _field(PIECE_KIND, UNUSED if token is None else NORMAL)))
    out.append(_field(PIECE, _field(PIECE_TEXT, _OUTSIDE.encode()) + _field(PIECE_SCORE, 0.0) + _field(PIECE_KIND, UNKNOWN)))
    out.append(_field(TRAINER, _field(TRAINER_MODEL, BPE) + _field(TRAINER_SIZE, len(tokens) + 1) + _field(TRAINER_UNKNOWN, len(tokens))))
    out.append(_field(NORMALIZER, _field(NORMALIZER_NAME, b"identity") + _field(ADD_PREFIX, 0) + _field(REMOVE_SPACES, 0) + _field(ESCAPE_SPACES, 0)))
    return b"".join(out)


# ---- coder -------------------------------------------------------------------------------------


def other_classes() -> dict[int, str]:
    """Characters whose class in the rank file's library is not Python's, each with a character of the right class."""
    every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    single = {bytes([b]): b for b in range(256)}
    found = {}
    for pattern, sample in _SAMPLE.items():
        own = tiktoken.Encoding("class", pat_str=pattern, mergeable_ranks=single, special_tokens={})
        theirs = bytes(own.encode_ordinary(every)).decode()
        found |= dict.fromkeys(map(ord, set(theirs) - set(regex.findall(pattern, every))), sample)
    return found


@dataclass
class Coder:
    """Encodes and decodes texts by the tokens of a rank file; sent to the tasks as a whole."""

    tokens: list[bytes | None]
    model: bytes
    pattern: str
    other: dict[int, str]

    @classmethod
    def load(cls, path: str, pattern: str) -> "Coder":
        with open(path, "rb") as f:
            ranks = {int(rank): base64.b64decode(token) for token, rank in map(bytes.split, f)}
        tokens = [ranks.get(i) for i in range(max(ranks) + 1)]
        return cls(tokens, serialise(tokens), pattern, other_classes())

    def __getstate__(self) -> dict:
        return {k: self.__dict__[k] for k in ("tokens", "model", "pattern", "other")}

    @cached_property
    def processor(self) -> sentencepiece.SentencePieceProcessor:
        return sentencepiece.SentencePieceProcessor(model_proto=self.model)

    @cached_property
    def whole(self) -> dict[str, int]:
        """Tokens that are valid texts, by text."""
        out = {}
        for i, t in enumerate(self.tokens):
            try:
                out[(t or b"").decode()] = i
            except UnicodeDecodeError:
                pass
        out.pop("", None)
        return out

    @cached_property
    def bytes_of(self) -> list[bytes]:
        """Bytes of each piece, from the model's own pieces; ids without a token have none."""
        sp = self.processor
        return [bytes(map(_BYTE.__getitem__, sp.id_to_piece(i))) if t is not None else b"" for i, t in enumerate(self.tokens)]

    @cached_property
    def _split(self) -> regex.Pattern:
        return regex.compile(self.pattern)

    @cached_property
    def _odd(self) -> set[str]:
        return set(map(chr, self.other))

    def pre_tokens(self, text: str) -> Iterator[list[str]]:
        """The pattern's matches in order, in lists of bounded size for long texts."""
        if not text.isascii() and not self._odd.isdisjoint(text):
            found = (text[m.start():m.end()] for m in self._split.finditer(text.translate(self.other)))
        elif len(text) <= AT_ONCE:
            yield self._split.findall(text)
            return
        else:
            found = (m[0] for m in self._split.finditer(text))
        while part := list(islice(found, AT_ONCE)):
            yield part

    def merge(self, words: list[str]) -> list[list[int]]:
        """Ids of each pre-token: its own if it is a token, else by the model's merges."""
        out: list = [[self.whole[w]] if w in self.whole else None for w in words]
        rest = [i for i, ids in enumerate(out) if ids is None]
        mapped = ["".join(map(_CHARS.__getitem__, words[i].encode())) for i in rest]
        for i, ids in zip(rest, self.processor.encode(mapped, out_type=int, num_threads=1) if mapped else []):
            out[i] = ids
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist()))


class Memory:
    """Ids of pre-tokens seen lately: number of each one, and their sequences one after the other."""

    def __init__(self, coder: Coder):
        self.coder = coder
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.cut, self.ids = np.zeros(1, np.int64), np.zeros(0, np.int32)

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all of ``words``, one after the other; how many each has)."""
        if len(self.number) > CACHED:
            self.clear()
        new = [w for w in dict.fromkeys(words) if w not in self.number]
        number = self.number
        if new:
            found = self.coder.merge(new)
            number |= zip(new, range(len(number), len(number) + len(new)))
            self.cut = np.concatenate((self.cut, self.cut[-1] + np.cumsum([len(x) for x in found])))
            self.ids = np.concatenate((self.ids, np.array([i for x in found for i in x], np.int32)))
        flat = _gather(self.cut, self.ids, np.fromiter(map(number.__getitem__, words), np.int64, len(words)))
        if any(len(w) > CACHED_CHARS for w in new):
            self.clear()
        return flat

    def encode_texts(self, texts: Iterator[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, one after the other; how many each has); some ``AT_ONCE`` pre-tokens are held."""
        words: list[str] = []
        owners: list[int] = []
        sizes: list[int] = []
        found, total, n = [np.zeros(0, np.int32)], np.zeros(0, np.int64), 0

        def flush() -> None:
            nonlocal total
            flat, size = self.encode(words)
            found.append(flat)
            more = np.bincount(np.repeat(owners, sizes), size, minlength=n).astype(np.int64)
            more[:len(total)] += total
            total = more
            for x in (words, owners, sizes):
                x.clear()

        for text in texts:
            for part in self.coder.pre_tokens(text):
                words += part
                owners.append(n)
                sizes.append(len(part))
                if len(words) >= AT_ONCE:
                    n += 1
                    flush()
                    n -= 1
            n += 1
        if words:
            flush()
        return np.concatenate(found), np.concatenate((total, np.zeros(n - len(total), np.int64)))


def encode(docs: DataFrame, coder: Coder, text_col: str = "text") -> DataFrame:
    """``docs`` plus ``ids`` array<int>, each match of the pattern on its own, without special tokens.

    One row per input row, repeated rows and null ids included; a null or empty text has no ids; an empty table
    gives an empty one.  An input column ``ids`` gives way to the new one, as with ``withColumn``; all others
    stay as they are, whatever their names."""
    sent = docs.sparkSession.sparkContext.broadcast(coder)
    given = small_batches(docs).select(*[c for c in docs.columns if c.lower() != "ids"])
    src = given.withColumn("ids", F.array().cast("array<int>"))
    names, kept = src.columns, len(given.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = Memory(sent.value)
        for batch in batches:
            for piece, data, off in pieces(batch, text_col, PIECE_BYTES):
                raw = data.tobytes()
                ids, size = memory.encode_texts(raw[a:b].decode() for a, b in zip(off.tolist(), off[1:].tolist()))
                cut = np.concatenate(([0], np.cumsum(size))).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*piece.columns[:kept], pa.ListArray.from_arrays(pa.array(cut), pa.array(ids, pa.int32()))], names)

    return src.mapInArrow(run, src.schema)


def decode(tokens: DataFrame, coder: Coder, ids_col: str = "ids", name: str = "decoded") -> DataFrame:
    """``tokens`` plus the bytes that ``ids_col`` stands for (binary); null ids give none.

    An input column ``name`` gives way to the new one; all others stay as they are."""
    sent = tokens.sparkSession.sparkContext.broadcast(coder)
    given = tokens.select(*[c for c in tokens.columns if c.lower() != name.lower()])
    src = given.withColumn(name, F.lit(b""))
    names, kept = src.columns, len(given.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(ids_col)
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                text = [sent.value.decode(x.values.to_numpy()) if x.is_valid else b"" for x in ids.slice(k, 256)]
                yield pa.RecordBatch.from_arrays([*part.columns[:kept], pa.array(text, pa.binary())], names)

    return src.mapInArrow(run, src.schema)


def digests(docs: DataFrame, coder: Coder, id_col: str = "doc_id") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (decimal ids joined by commas) and decoded_sha256 of every row."""
    out = decode(encode(docs.select(id_col, "text"), coder).select(id_col, "ids"), coder)
    return out.select(id_col, F.size("ids").cast("long").alias("n_tokens"),
                      F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
                      F.sha2("decoded", 256).alias("decoded_sha256"))
