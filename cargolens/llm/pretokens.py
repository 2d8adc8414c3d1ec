"""Pre-tokens of byte-level BPE tokenizers for many texts at once, without one Python object each.

A batch of texts is one byte buffer.  Its characters are classed (letter, number, white space, other)
by a table, and the pattern's matches are the runs of equal class with three rules: a space before a run
belongs to it, the last white space before a run stands alone unless it is a space, and an apostrophe at a
match's start takes the English endings.  All of that is done by array operations on run borders.

The table comes from Python's Unicode data.  Characters that its version leaves unassigned may be
classed otherwise by a tokenizer's own, later tables; a text with one of them is split by the tokenizer
library instead (``library_split``).  A test goes through all characters.
"""

from __future__ import annotations

import unicodedata

import numpy as np

from cargolens.llm.words import PIECE, U, mix, range_sums

#: FIXED: the split pattern of this family of byte-level tokenizers.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

OTHER, LETTER, NUMBER, WHITE, UNSURE = range(5)
_CODES = [mix(np.arange(1, 257, dtype=U) * U(k)) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)]
_table: list[np.ndarray] = []


def class_table() -> np.ndarray:
    """The class of each code point, worked out once a process."""
    if not _table:
        out = np.zeros(0x110000, np.uint8)
        for i in range(0x110000):
            kind = unicodedata.category(chr(i))
            if kind == "Cn":
                out[i] = UNSURE
            elif kind[0] == "L":
                out[i] = LETTER
            elif kind[0] == "N":
                out[i] = NUMBER
            elif chr(i).isspace() and not 0x1C <= i <= 0x1F:
                out[i] = WHITE
        _table.append(out)
    return _table[0]


def code_points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The code points of UTF-8 bytes and the byte where each starts."""
    high = data >= 0x80
    if not high.any():
        return data, np.arange(len(data))
    at = np.flatnonzero((data & 0xC0) != 0x80)
    first = data[at]
    point = first.astype(np.int32)
    for size, low, mask in ((2, 0xC0, 0x1F), (3, 0xE0, 0x0F), (4, 0xF0, 0x07)):
        k = np.flatnonzero((first >= low) & (first < (low | (mask + 1))))
        if len(k):
            value = (first[k] & mask).astype(np.int32)
            for j in range(1, size):
                value = (value << 6) | (data[np.minimum(at[k] + j, len(data) - 1)] & 0x3F)
            point[k] = value
    return point, at


def library_split(text: str) -> np.ndarray:
    """The byte offsets at which the matches of one text start, by the tokenizer library's own pattern."""
    from tokenizers.pre_tokenizers import ByteLevel

    pieces = ByteLevel(add_prefix_space=False, use_regex=True).pre_tokenize_str(text)
    # A piece holds one character for each of its bytes.
    return np.concatenate([[0], np.cumsum([len(p) for p, _ in pieces])[:-1]]).astype(np.int64) if pieces else np.zeros(0, np.int64)


def split(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first byte of every pre-token of the texts ``data[offsets[d]:offsets[d + 1]]``, and the index
    of each text's first pre-token (with the number of all at the end)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    point, at = code_points(data)
    kind = class_table()[point]
    head = np.zeros(len(point) + 1, bool)
    head[np.searchsorted(at, offsets)] = True
    head[-1] = True
    start = head[:-1].copy()
    start[1:] |= kind[1:] != kind[:-1]
    run = np.flatnonzero(start)
    end = np.append(run[1:], len(point))
    of = kind[run]
    joined = ~head[end]  # another run of the same text follows
    # White space before a run: its last character goes with the run (a space) or stands alone.
    k = np.flatnonzero((of == WHITE) & joined)
    last = end[k] - 1
    start[last] = True
    start[end[k[point[last] == 0x20]]] = False
    # An apostrophe that starts a match takes s, t, m, d, re, ve or ll after it.
    k = np.flatnonzero((of == OTHER) & joined & (end - run == 1))
    k = k[(point[run[k]] == 0x27) & start[run[k]]]
    k = k[of[k + 1] == LETTER]
    e, stop = end[k], end[k + 1]
    one = point[e]
    two = np.where(e + 1 < stop, point[np.minimum(e + 1, len(point) - 1)], 0)
    r, v, ll, ee = ord("r"), ord("v"), ord("l"), ord("e")
    size = np.where(np.isin(one, [ord(c) for c in "stmd"]), 1,
                    np.where((((one == r) | (one == v)) & (two == ee)) | ((one == ll) & (two == ll)), 2, 0))
    hit = size > 0
    start[e[hit]] = False
    rest = (e + size)[hit & (e + size < stop)]
    start[rest] = True
    tokens = at[start]
    unsure = kind == UNSURE
    if unsure.any():
        tokens = _mend(data, offsets, tokens, np.unique(np.searchsorted(offsets, at[unsure], side="right") - 1))
    return tokens, np.searchsorted(tokens, offsets)


def _mend(data: np.ndarray, offsets: np.ndarray, tokens: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """The splits with those of some texts taken from the library."""
    parts, done = [], 0
    for d in docs.tolist():
        a, b = int(offsets[d]), int(offsets[d + 1])
        parts.append(tokens[done: np.searchsorted(tokens, a)])
        parts.append(library_split(data[a:b].tobytes().decode("utf-8", "replace")) + a)
        done = int(np.searchsorted(tokens, b))
    return np.concatenate([*parts, tokens[done:]])


def hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, which: int = 0) -> np.ndarray:
    """A 64-bit hash of each byte range; two unrelated ones by ``which``.  Ranges ascend."""
    code, out, i = _CODES[which], np.empty(len(start), U), 0
    while i < len(start):  # pieces that start and end with a range
        j = max(i + 1, int(np.searchsorted(start, start[i] + PIECE)))
        a, b = int(start[i]), int(end[j - 1])
        out[i:j] = range_sums(code[data[a:b]], start[i:j] - a, end[i:j] - a)
        i = j
    return mix(out + (end - start).astype(U) * U(0x9E3779B97F4A7C15))


def distinct(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(one index for each different byte range, the place among those of every range).

    Ranges are told apart by a 64-bit hash; where a second hash shows that unequal ones met, by both.
    """
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    h, again = hashes(data, start, end), hashes(data, start, end, 1)
    _, first, code = np.unique(h, return_index=True, return_inverse=True)
    if (again != again[first][code]).any():
        _, first, code = np.unique(np.stack([h, again], 1), axis=0, return_index=True, return_inverse=True)
    return first, code.reshape(-1)


def pick_bytes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of some ranges one after another, and where each starts in them."""
    size = end - start
    at = np.concatenate([[0], np.cumsum(size)])
    take = np.arange(at[-1]) - np.repeat(at[:-1], size) + np.repeat(start, size)
    return data[take], at
