"""Words and word n-grams of Arrow text columns as NumPy arrays.

A word is a run of ASCII letters and digits and of characters outside ASCII, with
A-Z lower-cased. UTF-8 keeps every byte of a character outside ASCII at 128 or
above, so words are found on bytes. Texts are handled in blocks of about
``BLOCK`` bytes. A longer text is a block of its own; its words are found part by
part, so that besides the text about 4 bytes are held for each of its bytes (24 for
each word), and n-grams add as much again for the time they are used.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

BLOCK = 1 << 18
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_WORD = np.zeros(256, dtype=bool)
IS_WORD[48:58] = IS_WORD[65:91] = IS_WORD[97:123] = IS_WORD[128:] = True

_powers = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; tables up to a block are kept."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, BLOCK + 1)
        have = np.full(size, base, dtype=np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if size <= 4 * BLOCK:
            _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a string or binary array; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    return offsets, np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)


def blocks(offsets: np.ndarray, size: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``size`` bytes, or of one row."""
    row, rows = 0, len(offsets) - 1
    while row < rows:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + size, side="right")) - 1)
        yield row, min(end, rows)
        row = end


@dataclass
class Words:
    """The words of rows ``first`` to ``last`` of a column."""

    first: int
    last: int
    data: np.ndarray  #: lower-cased bytes of the rows
    offsets: np.ndarray  #: of the rows in data
    starts: np.ndarray  #: of the words in data
    ends: np.ndarray
    hashes: np.ndarray
    bounds: np.ndarray  #: words of row k: bounds[k] to bounds[k + 1]

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hashes of the n-grams within rows, their first words, and bounds by row."""
        total = len(self.hashes) - n + 1
        counts = np.maximum(np.diff(self.bounds) - n + 1, 0)
        bounds = np.concatenate(([0], np.cumsum(counts)))
        if total <= 0 or not bounds[-1]:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64), bounds
        if n == 1:
            out = self.hashes
        else:
            out = self.hashes[:total].copy()
            for k in range(1, n):
                out += self.hashes[k : total + k] * np.uint64(pow(BASE, k, 1 << 64))
            out = mix(out + np.uint64(n))
        at = np.repeat(self.bounds[:-1] - bounds[:-1], counts) + np.arange(bounds[-1])
        return (out if len(at) == len(out) else out[at]), at, bounds

    def text(self, first: int, last: int) -> str:
        """Words first to last, joined by blanks."""
        return " ".join(bytes(self.data[self.starts[k] : self.ends[k]]).decode("utf-8", "replace") for k in range(first, last))


def words(column: pa.Array, size: int = BLOCK) -> Iterator[Words]:
    offsets, data = text_buffers(column)
    for first, last in blocks(offsets, size):
        yield words_of(offsets[first : last + 1], data, first, last, size)


def parts(raw: np.ndarray, cut: np.ndarray, size: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Ranges of at most ``size`` bytes that together are ``raw``, each but the last ending after a byte that ``cut`` marks (by value); a run without such a byte isn't cut."""
    at = 0
    while at < len(raw):
        end = at + size
        if end < len(raw):
            back = np.flatnonzero(cut[raw[at:end]])
            if len(back):
                end = at + int(back[-1]) + 1
            else:
                while end < len(raw) and not cut[raw[end - 1]]:
                    ahead = np.flatnonzero(cut[raw[end : end + size]])
                    end = end + int(ahead[0]) + 1 if len(ahead) else min(end + size, len(raw))
        end = min(end, len(raw))
        yield at, end
        at = end


def words_of(offsets: np.ndarray, data: np.ndarray, first: int, last: int, size: int = BLOCK) -> Words:
    low = LOWER[data[offsets[0] : offsets[-1]]]
    at = offsets - offsets[0]
    if last - first > 1 or len(low) <= size:
        starts, ends, hashes = found(low, at)
    else:
        each = [tuple(x + a if k < 2 else x for k, x in enumerate(found(low[a:b], np.array([0, b - a])))) for a, b in parts(low, ~IS_WORD, size)]
        starts, ends, hashes = (np.concatenate(x) for x in zip(*each, strict=True))
    return Words(first, last, low, at, starts, ends, hashes, np.searchsorted(starts, at))


def found(part: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of the words of lower-cased rows that begin at ``at``."""
    inside = IS_WORD[part]
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    row_starts = at[:-1][at[:-1] < len(part)]
    begin[row_starts] = inside[row_starts]
    finish = np.zeros(len(part) + 1, dtype=bool)
    finish[1:] = inside
    finish[1:-1] &= ~inside[1:]
    cut = row_starts[row_starts > 0]
    finish[cut] = inside[cut - 1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(finish)
    sums = np.zeros(len(part) + 1, np.uint64)
    np.cumsum((part.astype(np.uint64) + np.uint64(1)) * powers(BASE, len(part)), out=sums[1:])
    return starts, ends, mix((sums[ends] - sums[starts]) * powers(INVERSE, len(part) + 1)[starts])
