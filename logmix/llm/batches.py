"""Arithmetic on batches of texts: words, their hashes, and packed arrays of 64-bit keys. Runs inside Spark tasks.

A word is a run of bytes other than the blanks 0x20 and 0x09-0x0D, with A-Z lower-cased. All words of a slice of texts are
hashed at once: a prefix sum of ``table[byte] * P^i`` gives every word's polynomial by two look-ups.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard

# Texts are worked on in slices of about this many bytes, so that memory does not follow the size of a batch.
SLICE_BYTES = 512 << 10

_SEED = 20240607
_P = np.uint64(0x9E3779B97F4A7C15)  # odd
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_BYTES = np.random.Generator(np.random.PCG64(_SEED)).integers(1, 2**64, 256, dtype=np.uint64)
_LOWERED = _BYTES.copy()
_LOWERED[65:91] = _BYTES[97:123]
_IS_BLANK = np.zeros(256, bool)
_IS_BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_powers = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit numbers."""
    x = x ^ (x >> np.uint64(33))
    x *= _M1
    x ^= x >> np.uint64(33)
    x *= _M2
    x ^= x >> np.uint64(33)
    return x


def unmix(x: np.ndarray) -> np.ndarray:
    """The inverse of ``mix``."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(pow(int(_M2), -1, 2**64))
    x ^= x >> np.uint64(33)
    x *= np.uint64(pow(int(_M1), -1, 2**64))
    x ^= x >> np.uint64(33)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """``P^i`` and ``P^-i`` for i below ``n``, kept for the next call."""
    global _powers
    if len(_powers[0]) < n:
        size = max(n, SLICE_BYTES + 4096)
        made = []
        for base in (int(_P), pow(int(_P), -1, 2**64)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            made.append(np.cumprod(steps, dtype=np.uint64))
        _powers = tuple(made)
    return _powers[0][:n], _powers[1][:n]


def prefix_hash(data: np.ndarray, table: np.ndarray) -> np.ndarray:
    """``out[e] - out[s]`` times ``P^-s`` depends only on the bytes s to e."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(table[data] * powers(len(data))[0], dtype=np.uint64, out=out[1:])
    return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    inverse = powers(len(prefix))[1]
    return mix((prefix[ends] - prefix[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def raw_texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column, end to end, and each text's bounds; a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if column.buffers()[2] is None:
        return np.zeros(0, np.uint8), offsets - offsets[0]
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def slices(offsets: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of whole texts of about ``most`` bytes; a longer text stands alone."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last
        first = last


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words of a slice, in order, and the number of words of each text."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offsets) - 1, np.int64)
    inside = ~_IS_BLANK[data]
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    begins, closes = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1] | cut[1:-1]
    closes[:-1] &= ~inside[1:] | cut[1:-1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(closes) + 1
    hashes = span_hash(prefix_hash(data, _LOWERED), starts, ends)
    return hashes, np.diff(np.searchsorted(starts, offsets))


def shingles(hashes: np.ndarray, counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words, and their number by text; a shorter text's words are one shingle."""
    rolled = hashes.copy()
    with np.errstate(over="ignore"):
        for k in range(1, size):
            rolled[: len(hashes) - k] += mix(hashes[k:] + np.uint64(k)) if len(hashes) > k else 0
    ends = np.cumsum(counts)
    number = np.where(counts >= size, counts - size + 1, (counts > 0).astype(np.int64))
    keep = np.arange(len(hashes)) < np.repeat(ends - counts + number, counts)
    short = np.flatnonzero((counts > 0) & (counts < size))
    for i in short:  # sums of fewer words
        a, b = ends[i] - counts[i], ends[i]
        rest = mix(hashes[a + 1 : b] + np.arange(1, b - a, dtype=np.uint64))
        rolled[a] = np.concatenate([hashes[a : a + 1], rest, [np.uint64(b - a)]]).sum(dtype=np.uint64)
    return mix(rolled[keep]), number


def pack(keys: np.ndarray, *values: np.ndarray) -> bytes:
    """Sorted 64-bit keys and numbers beside them, as bytes: differences of the keys, byte planes, compressed."""
    planes = np.ascontiguousarray(np.diff(keys, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8).T)
    parts = [planes.tobytes()]
    for value in values:
        value = np.ascontiguousarray(value, "<u8")
        parts.append(np.ascontiguousarray(value.view(np.uint8).reshape(-1, 8).T).tobytes())
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def unpack(blob: bytes, columns: int) -> list[np.ndarray]:
    """The arrays of ``pack``, keys first."""
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(columns, 8, -1)
    out = [np.ascontiguousarray(planes.T).view("<u8").ravel() for planes in raw]
    out[0] = np.cumsum(out[0], dtype=np.uint64)
    return out


def summed(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys in order, and the sums of the values beside them."""
    if not len(keys):
        return (keys, *values)
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return (keys[first], *(np.add.reduceat(v[order], first) for v in values))


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each scrambled key: equal ranges of the key space."""
    return ((keys >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def shard_bounds(sorted_keys: np.ndarray, shards: int) -> np.ndarray:
    """Where each shard begins in sorted keys."""
    return np.searchsorted(shard_of(sorted_keys, shards), np.arange(shards + 1))
