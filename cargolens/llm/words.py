"""Words of many texts at once as 64-bit hashes, without one Python object a word.

A batch of texts is one byte buffer.  Words are the runs between white space (space and U+0009 to
U+000D); the hash of a word comes from running sums of ``code[byte] * base ** position`` (mod 2^64),
moved to the word's start by the base's inverse and mixed.  The sums run over pieces of the buffer,
so their memory doesn't grow with a text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
BASE = 0xD6E8FEB86659FD93
INVERSE = pow(BASE, -1, 1 << 64)
PIECE = 1 << 19
#: Bytes of text that are worked on together.
GROUP = 2 << 20

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose output bits all depend on all input bits."""
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    x ^= x >> U(29)
    x *= U(0xA3B195354A39B70D)
    x ^= x >> U(32)
    return x


CODE = mix(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15))
#: The same code for A-Z as for a-z.
FOLDED = CODE.copy()
FOLDED[0x41:0x5B] = CODE[0x61:0x7B]
#: Unrelated odd multipliers for the places in a run of words; multiples of one number would let
#: different orders of the same words have equal sums.
PLACES = mix(np.arange(1001, 1065, dtype=U) * U(0x9E3779B97F4A7C15)) | U(1)
_powers = [np.ones(1, U), np.ones(1, U)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """``BASE ** i`` and its inverse for i < n."""
    if len(_powers[0]) < n:
        m = max(n, PIECE + 4096)
        for k, b in enumerate((BASE, INVERSE)):
            x = np.full(m, U(b), U)
            x[0] = 1
            _powers[k] = np.cumprod(x, dtype=U)
    if n > 4 * PIECE:  # one huge word: don't keep them
        out = _powers[0], _powers[1]
        _powers[0], _powers[1] = np.ones(1, U), np.ones(1, U)
        return out
    return _powers[0], _powers[1]


def range_sums(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """For each range the sum of ``values[start + i] * BASE ** i``: equal sequences have equal sums.

    ``start`` ascends and so does ``end``.
    """
    out = np.empty(len(start), U)
    i = 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(start, start[i] + PIECE)))
        a, b = int(start[i]), int(end[j - 1])
        up, down = powers(b - a + 1)
        s = np.empty(b - a + 1, U)
        s[0] = 0
        np.cumsum(values[a:b] * up[: b - a], dtype=U, out=s[1:])
        lo = start[i:j] - a
        out[i:j] = (s[end[i:j] - a] - s[lo]) * down[lo]
        i = j
    return out


class Words:
    """Hashes ``h`` of all words, in order, with ``first[d]`` the index of document d's first word."""

    __slots__ = ("end", "first", "h", "n", "start")

    def __init__(self, data: np.ndarray, offsets: np.ndarray, code: np.ndarray = CODE):
        space = IS_SPACE[data]
        begin, stop = ~space, ~space
        if len(data):
            begin[1:] &= space[:-1]
            stop[:-1] &= space[1:]
            heads = offsets[:-1][offsets[:-1] < len(data)]
            begin[heads] |= ~space[heads]
            tails = heads[heads > 0] - 1
            stop[tails] |= ~space[tails]
        self.start, self.end = np.flatnonzero(begin), np.flatnonzero(stop) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.n = np.diff(self.first)
        h = np.empty(len(self.start), U)
        i = 0
        while i < len(h):  # pieces that start and end with a word
            j = max(i + 1, int(np.searchsorted(self.start, self.start[i] + PIECE)))
            a, b = int(self.start[i]), int(self.end[j - 1])
            h[i:j] = range_sums(code[data[a:b]], self.start[i:j] - a, self.end[i:j] - a)
            i = j
        self.h = mix(h + (self.end - self.start).astype(U) * U(0x9E3779B97F4A7C15))

    def document(self) -> np.ndarray:
        """The document of each word."""
        return np.repeat(np.arange(len(self.n)), self.n)


def buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and offsets of a string array, null as empty; nothing is copied for 32-bit offsets."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = texts.buffers()
    o = np.frombuffer(off, np.int64 if wide else np.int32)[texts.offset: texts.offset + len(texts) + 1].astype(np.int64)
    d = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return d[o[0]: o[-1]], o - o[0]


def groups(texts: pa.Array, limit: int = GROUP) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Rows [a, b) with their bytes and offsets, about ``limit`` bytes or one text at a time."""
    data, o = buffer(texts)
    a = 0
    while a < len(o) - 1:
        b = max(a + 1, int(np.searchsorted(o, o[a] + limit, side="right")) - 1)
        yield a, b, data[o[a]: o[b]], o[a: b + 1] - o[a]
        a = b


def shingles(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words and each document's number of them.

    A document with fewer words, but some, has one: its whole sequence.
    """
    h, n = words.h, words.n
    count = np.where(n >= size, n - size + 1, np.minimum(n, 1))
    doc_first = words.first[:-1]
    total = int(count.sum())
    at = np.arange(total) - np.repeat(np.cumsum(count) - count, count) + np.repeat(doc_first, count)
    length = np.repeat(np.minimum(n, size), count)
    out = length.astype(U) * U(0x9E3779B97F4A7C15)
    full = length == size
    whole = bool(full.all())
    last = len(h) - 1
    for i in range(size):
        term = h[np.minimum(at + i, last)] * PLACES[i] if total else np.zeros(0, U)
        out += term if whole else np.where(length > i, term, U(0))
    return mix(out), count
