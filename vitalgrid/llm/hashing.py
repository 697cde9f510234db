"""Vectorised hashing of words and byte windows over Arrow string batches (numpy, bounded blocks)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

# Bytes hashed at a time: bounds the working arrays to about a dozen MB whatever the batch.
BLOCK = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_TABLE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers: dict[str, np.ndarray] = {}


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """b**0 .. b**n modulo 2**64 of the rolling base (or of its inverse)."""
    name = "inverse" if inverse else "base"
    if name not in _powers or len(_powers[name]) <= n:
        steps = np.full(max(n + 1, BLOCK + 1), _INVERSE if inverse else _BASE, np.uint64)
        steps[0] = 1
        _powers[name] = np.multiply.accumulate(steps)
    return _powers[name]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the word."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def prefix(data: np.ndarray) -> np.ndarray:
    """Prefix sums of the polynomial hash of a byte array (length n + 1)."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_TABLE[data] * powers(len(data))[: len(data)], out=out[1:])
    return out


def windows(sums: np.ndarray, starts: np.ndarray, length: int | np.ndarray) -> np.ndarray:
    """Hashes of the byte strings at ``starts``: equal strings hash alike wherever they stand."""
    return mix((sums[starts + length] - sums[starts]) * powers(len(sums), inverse=True)[starts])


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column without copying; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_binary())
    bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), bounds


def groups_of_rows(bounds: np.ndarray) -> Iterator[tuple[int, int]]:
    """Row ranges of about BLOCK bytes (one row at least)."""
    first, n = 0, len(bounds) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(bounds, bounds[first] + BLOCK, side="right")) - 1)
        yield first, min(last, n)
        first = min(last, n)


def _words(data: np.ndarray, starts_of_rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, start) of every word of lower-cased bytes; rows begin at the given places."""
    space = _SPACE[data]
    begins = ~space
    begins[1:] &= space[:-1]
    at = starts_of_rows[starts_of_rows < len(data)]
    begins[at] = ~space[at]
    starts = np.flatnonzero(begins)
    ends = ~space
    ends[:-1] &= space[1:]
    before = at[at > 0] - 1
    ends[before] = ~space[before]
    stops = np.flatnonzero(ends) + 1
    sums = prefix(_LOWER[data])
    return mix(windows(sums, starts, stops - starts) + (stops - starts).astype(np.uint64)), starts


def shingle_sets(data: np.ndarray, bounds: np.ndarray, size: int) -> list[np.ndarray]:
    """The sorted distinct hashes of every row's ``size``-word shingles.

    Words are runs of bytes other than ASCII white space, A-Z in lower case. A row of fewer words has one
    shingle, the whole sequence; a row without words has none.
    """
    out: list[np.ndarray] = []
    for first, last in groups_of_rows(bounds):
        at, rows = bounds[first], bounds[first : last + 1] - bounds[first]
        hashes, starts = _block_words(data[at : bounds[last]], rows)
        cuts = np.searchsorted(starts, rows)
        rolled = hashes
        for k in range(1, size):
            if len(hashes) <= k:
                break
            rolled = rolled[: len(hashes) - k] * np.uint64(0xD6E8FEB86659FD93) + hashes[k:]
        rolled = mix(rolled)
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if b - a >= size:
                own = np.sort(rolled[a : b - size + 1])
                out.append(own[np.concatenate(([True], own[1:] != own[:-1]))])
            elif b > a:
                whole = np.uint64(b - a)
                with np.errstate(over="ignore"):
                    for h in hashes[a:b]:
                        whole = whole * np.uint64(0xD6E8FEB86659FD93) + h
                out.append(mix(np.array([whole], np.uint64)))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def _block_words(data: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As ``_words``; a very long row is cut between words so that the arrays stay bounded."""
    if len(data) <= 4 * BLOCK:
        return _words(data, rows)
    parts, at = [], 0
    while at < len(data):
        end = min(len(data), at + BLOCK)
        while end < len(data) and not _SPACE[data[end]]:
            end += 1
        inside = rows[(rows >= at) & (rows < end)] - at
        h, s = _words(data[at:end], inside)
        parts.append((h, s + at))
        at = end
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
