"""Words of Arrow text columns as numpy arrays, without Python strings.

A word is ``[^\\x20\\x09-\\x0D]+``. Its 64-bit hash is a sum over its bytes, each
by a number of its own for every place in the word, then mixed; one running sum
serves all words of a chunk.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SAME = np.arange(256, dtype=np.uint8)

_tables: dict[int, np.ndarray] = {}  # powers by base; 0: factors


def powers(base: int, n: int) -> np.ndarray:
    """``base**0 .. base**(n-1)`` modulo 2**64, kept between calls."""
    have = _tables.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, CHUNK + 1), base, dtype=_U)
        steps[0] = 1
        have = _tables[base] = np.cumprod(steps, dtype=_U)
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser, so that all bits depend on all bits."""
    h = h ^ (h >> _U(33))
    h = h * _U(0xFF51AFD7ED558CCD)
    h = h ^ (h >> _U(33))
    h = h * _U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> _U(33))


#: A number for each byte value.
BYTES = mix(np.arange(1, 257, dtype=_U) * _U(0x9FB21C651E98DF25))


def rolling(h: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of ``width`` values; empty if there are fewer."""
    n = len(h) - width + 1
    if n <= 0:
        return np.empty(0, _U)
    if width <= 8:
        out = np.zeros(n, _U)
        for j in range(width):
            out = out * _U(_BASE) + h[j : j + n]
    else:
        sums = np.zeros(len(h) + 1, _U)
        np.cumsum(h * powers(_INVERSE, len(h)), out=sums[1:])
        out = (sums[width:] - sums[:n]) * powers(_BASE, n)
    return mix(out)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column. A null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not (pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)):
        column = column.cast(pa.large_string() if pa.types.is_string(column.type) else pa.large_binary())
    n = len(column)
    if n == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[ends[0] : ends[-1]], ends - ends[0]


@dataclass
class Words:
    """Words of some consecutive rows.

    ``first[i]:first[i+1]`` are the words of row ``row + i``; ``start`` and
    ``end`` are byte places in ``data``.
    """

    row: int
    data: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray


def _spans(data: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    space = SPACE[data]
    solid = ~space
    before = np.empty(len(data), bool)
    before[0] = True
    before[1:] = space[:-1]
    before[breaks] = True
    after = np.empty(len(data), bool)
    after[-1] = True
    after[:-1] = before[1:] & solid[:-1] | space[1:]
    start = np.flatnonzero(solid & before)
    end = np.flatnonzero(solid & after) + 1
    return start, end


def factors(n: int) -> np.ndarray:
    """``n`` odd numbers without a pattern, the same ones each time."""
    have = _tables.get(0)
    if have is None or len(have) < n:
        have = _tables[0] = mix(np.arange(1, max(n, 4096) + 1, dtype=_U) * _U(0xD6E8FEB86659FD93)) | _U(1)
    return have[:n]


def _hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    if not len(start):
        return np.empty(0, _U)
    size = end - start
    ends = np.cumsum(size)
    begins = ends - size
    place = np.arange(ends[-1]) - np.repeat(begins, size)
    by = BYTES[data[np.repeat(start, size) + place]] * factors(int(size.max()))[place]
    return mix(np.add.reduceat(by, begins) + size.astype(_U) * _U(0xD6E8FEB86659FD93))


def sequence(h: np.ndarray) -> int:
    """One number for a whole sequence of hashes, of any length."""
    return int(mix(np.array([(h * factors(len(h))).sum(dtype=_U) + _U(len(h))], _U))[0]) if len(h) else 0


def _split(data: np.ndarray) -> Iterator[tuple[int, int]]:
    """Pieces of about CHUNK bytes that end at white space."""
    at = 0
    while at < len(data):
        to = min(len(data), at + CHUNK)
        while to < len(data):
            found = np.flatnonzero(SPACE[data[at:to]])
            if len(found):
                to = at + int(found[-1]) + 1
                break
            to = min(len(data), to + CHUNK)
        yield at, to
        at = to


def words(column: pa.Array, table: np.ndarray = SAME) -> Iterator[Words]:
    """Word arrays of a text column, about CHUNK bytes of whole rows at a time.

    ``table`` maps bytes first, for example :data:`LOWER`. Every row comes
    once, in order; a longer row comes alone and is hashed in pieces.
    """
    raw, offsets = buffers(column)
    n, row = len(offsets) - 1, 0
    while row < n:
        to = max(row + 1, int(np.searchsorted(offsets, offsets[row] + CHUNK, "right")) - 1)
        own = offsets[row : to + 1] - offsets[row]
        data = table[raw[offsets[row] : offsets[to]]]
        if len(data) == 0:
            start = end = np.empty(0, np.int64)
            h = np.empty(0, _U)
        elif len(data) <= 2 * CHUNK:
            start, end = _spans(data, own[:-1][own[:-1] < len(data)])
            h = _hashes(data, start, end)
        else:
            parts = []
            for a, b in _split(data):
                s, e = _spans(data[a:b], np.zeros(1, np.int64))
                parts.append((s + a, e + a, _hashes(data[a:b], s, e)))
            start, end, h = (np.concatenate(x) for x in zip(*parts, strict=True))
        yield Words(row, data, own, start, end, h, np.searchsorted(start, own))
        row = to
