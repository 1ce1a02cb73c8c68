"""Words and word shingles of many texts at once, as 64-bit hashes."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import mixed

_BASE = np.uint64(0xC2B2AE3D27D4EB4F)
_SHINGLE = np.uint64(0xD1342543DE82EF95)
_GAP = np.zeros(256, dtype=bool)
_GAP[[0x20, *range(0x09, 0x0E)]] = True
_CODE = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
#: Bytes of one numpy pass.
PASS = 2 << 20


@lru_cache(maxsize=4)
def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def _size(n: int) -> int:
    """n rounded up, so that few tables of powers are made."""
    return 1 << max(16, (n - 1).bit_length())


def inverse(base: np.uint64) -> int:
    return pow(int(base), -1, 1 << 64)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts one after the other, and where each begins, with the end. Null is empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data else np.zeros(0, dtype=np.uint8)
    return raw[ends[0] : ends[-1]], ends - ends[0]


def passes(column: pa.Array, size: int = PASS) -> Iterator[tuple[int, pa.Array]]:
    """Slices of a text column with about `size` bytes, or one longer text, and where each begins."""
    lengths = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    begin, held = 0, 0
    for i, n in enumerate(lengths.tolist()):
        if i > begin and held + n > size:
            yield begin, column.slice(begin, i - begin)
            begin, held = i, 0
        held += n
    if begin < len(column):
        yield begin, column.slice(begin)


def sequence_keys(code: np.ndarray, first: np.ndarray, counts: np.ndarray, base: np.uint64) -> np.ndarray:
    """A hash of each run of code that begins at first and has counts members."""
    n = _size(len(code) + 1)
    sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(code * powers(int(base), n)[: len(code)], dtype=np.uint64)])
    return mixed((sums[first + counts] - sums[first]) * powers(inverse(base), n)[first] + mixed(counts.astype(np.uint64)))


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A hash for every word of every text, in order, and how many words each text has."""
    raw, ends = text_bytes(column)
    inside = np.zeros(len(raw) + 1, dtype=bool)
    inside[:-1] = ~_GAP[raw]
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    starts[ends[:-1]] = inside[ends[:-1]]  # a text's first byte begins a word though the text before ends with one
    at = np.flatnonzero(starts)
    text = np.searchsorted(ends, at, side="right") - 1
    stops = np.flatnonzero(~inside)
    stop = np.minimum(stops[np.searchsorted(stops, at)], ends[text + 1])
    counts = np.bincount(text, minlength=len(ends) - 1)
    return sequence_keys(_CODE[raw], at, stop - at, _BASE), counts


def shingles(hashes: np.ndarray, counts: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of every run of `width` words; a text with fewer words is one shingle, one without words has none."""
    first = np.cumsum(counts) - counts
    number = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    text = np.repeat(np.arange(len(counts)), number)
    at = np.arange(len(text)) - np.repeat(np.cumsum(number) - number, number) + first[text]
    key = np.zeros(len(at), dtype=np.uint64)
    short = np.minimum(counts, width)[text]
    for j in range(width):
        key = key * _SHINGLE + np.where(j < short, hashes[np.minimum(at + j, max(len(hashes) - 1, 0))], np.uint64(j)) if len(hashes) else key
    return text, mixed(key)
