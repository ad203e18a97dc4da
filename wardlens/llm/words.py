"""Words of many texts at once, as numpy arrays.

A word is a maximal run of digits, letters (A-Z lower-cased) and non-ASCII
characters: bytes 0x30-0x39, 0x61-0x7A and 0x80-0xFF of the UTF-8 text.
"""

from __future__ import annotations

import numpy as np

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[97:123] = _WORD[128:] = True
_MASK = np.array([(1 << 8 * k) - 1 for k in range(8)] + [(1 << 64) - 1], dtype=np.uint64)
_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(32))) * _MIX
    x = (x ^ (x >> np.uint64(29))) * _ODD
    return x ^ (x >> np.uint64(32))


class Words:
    """Words of the texts ``data[off[i]:off[i + 1]]`` in order.

    start, size: byte range of each word in ``data`` (lower-cased copy);
    doc: index of its text; first: for each text (and one past the last) the
    index of its first word.

    ``alphabet`` names the bytes that make up words (256 booleans, looked up after folding) and
    ``fold`` the byte that each byte becomes, so operators with words of their own share this class."""

    def __init__(self, data: np.ndarray, off: np.ndarray, alphabet: np.ndarray = _WORD, fold: np.ndarray = _LOWER):
        self.data = np.concatenate((fold[data], np.zeros(8, np.uint8)))
        inside = alphabet[self.data[:len(data)]]
        cut = np.zeros(len(data) + 1, bool)  # a text begins here
        cut[off] = True
        begin = inside.copy()
        begin[1:] &= ~inside[:-1] | cut[1:-1]
        end = inside.copy()
        end[:-1] &= ~inside[1:] | cut[1:-1]
        self.start = np.flatnonzero(begin)
        self.size = np.flatnonzero(end) + 1 - self.start
        self.first = np.searchsorted(self.start, off)
        self.doc = np.repeat(np.arange(len(off) - 1), np.diff(self.first))
        #: the 8 bytes from each position on, as one number
        self.eight = np.ndarray((len(data) + 1,), "<u8", self.data.data, strides=(1,))

    def __len__(self) -> int:
        return len(self.start)

    def chunk(self, at: int, of: np.ndarray | slice = slice(None)) -> np.ndarray:
        """Bytes 8 * at to 8 * at + 8 of words longer than 8 * at, as numbers (zero beyond the word)."""
        size = self.size[of] - 8 * at
        return self.eight[self.start[of] + 8 * at] & _MASK[np.minimum(size, 8)]

    def codes(self, seed: int = 0) -> np.ndarray:
        """A 64-bit hash of each word; without collisions among words of up to 8 bytes without zero bytes."""
        code = mix(self.chunk(0) + np.uint64(seed))
        at, left = 1, np.flatnonzero(self.size > 8)
        while len(left):
            code[left] = mix(code[left] * _ODD + self.chunk(at, left) + np.uint64(at))
            at += 1
            left = left[self.size[left] > 8 * at]
        return code

    def word(self, i: int) -> bytes:
        return self.data[self.start[i]:self.start[i] + self.size[i]].tobytes()

    def distinct(self) -> tuple[np.ndarray, np.ndarray]:
        """(one word of each kind, kind of each word); bytes are compared, not only hashes."""
        codes = self.codes()
        _, one, kind = np.unique(codes, return_index=True, return_inverse=True)
        at, rest, same = 0, np.arange(len(codes)), bool(np.all(self.size == self.size[one[kind]])) if len(codes) else True
        while same and len(rest):
            same = bool(np.all(self.chunk(at, rest) == self.chunk(at, one[kind[rest]])))
            at += 1
            rest = rest[self.size[rest] > 8 * at]
        if not same:  # two words share a hash: compare as strings
            _, one, kind = np.unique(np.array([self.word(i) for i in range(len(self))], dtype=object), return_index=True, return_inverse=True)
        return one, kind
