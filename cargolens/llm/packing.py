"""Whole numbers as small byte strings, for rows that are written or shuffled."""

from __future__ import annotations

import numpy as np
import zstandard

#: Levels for numbers, whose parts are near their entropy anyway, and for text.
LEVEL, TEXT_LEVEL = 1, 6


def _planes(x: np.ndarray, width: int) -> bytes:
    return x.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T.tobytes()


def pack(x: np.ndarray, width: int = 4) -> bytes:
    """Unsigned numbers of ``width`` bytes: equal bytes of all numbers side by side, then zstd."""
    return zstandard.ZstdCompressor(level=LEVEL).compress(_planes(x, width))


def unpack(data: bytes, width: int = 4) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(width, -1).T).view(f"<u{width}").reshape(-1).astype(np.int64)


def pack_sorted(x: np.ndarray, width: int = 4) -> bytes:
    """Ascending numbers, as their differences."""
    return pack(np.diff(x, prepend=0), width)


def unpack_sorted(data: bytes, width: int = 4) -> np.ndarray:
    return np.cumsum(unpack(data, width))


def pack_bytes(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=TEXT_LEVEL).compress(data)


def unpack_bytes(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def spans(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The indices of all given spans one after another."""
    if not len(size):
        return np.zeros(0, np.int64)
    end = np.cumsum(size)
    return np.arange(end[-1]) - np.repeat(end - size, size) + np.repeat(start, size)
