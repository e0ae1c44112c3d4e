"""Vectorised work on the UTF-8 buffers of Arrow string columns.

Words, word hashes and shingle hashes are computed for many documents at once
with NumPy; a Python-level step is taken per document at most, never per word.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: Bytes of text that are worked on at once; a longer document is a block of its own.
BLOCK = 2 << 20

_rng = np.random.Generator(np.random.PCG64(20240229))
_TABLE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)
MIX = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) * U64(2) + U64(1)

#: Bytes of a span beyond which it is hashed by a digest of its own instead of eight bytes at a time.
LONG = 256
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], U64)

#: `[^\x20\x09-\x0D]` and `[^\x00-\x2F\x3A-\x60\x7B-\x7F]` after lower-casing, by byte.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x41:0x5B] = ALNUM[0x80:] = True

_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least n of each."""
    if len(_powers.get("up", ())) < n:
        size = max(n, 1 << 16)
        for name, base in (("up", _BASE), ("down", _BASE_INV)):
            out = np.empty(size, U64)
            out[0], have = 1, 1
            while have < size:
                step = min(have, size - have)
                out[have : have + step] = out[:step] * U64(pow(base, have, 1 << 64))
                have += step
            _powers[name] = out
    return _powers["up"][:n], _powers["down"][:n]


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser (Stafford's variant 13); another seed gives another order of the same values."""
    x = x + U64((0x9E3779B97F4A7C15 * (seed + 1)) & ((1 << 64) - 1))
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def blocks(column: pa.Array, limit: int = BLOCK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of runs of rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    if not len(column):
        return
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    offs = np.frombuffer(column.buffers()[1], np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(offs, offs[row] + limit, "right")) - 1)
        end = min(end, len(column))
        yield row, end, data[offs[row] : offs[end]], offs[row : end + 1] - offs[row]
        row = end


def words(data: np.ndarray, offs: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words (maximal runs of bytes in ``kind`` within one document), and words per document."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offs) - 1, np.int64)
    inside = kind[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    cuts = offs[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    first[cuts] = inside[cuts]
    last[cuts - 1] = inside[cuts - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.diff(np.searchsorted(starts, offs))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """64-bit hashes of the byte spans, ASCII letters folded if ``lower``.

    Eight bytes at a time enter between full mixing steps; spans of equal length
    up to eight bytes never collide, and no structure of a longer one does.
    """
    size = ends - starts
    out = mix(size.astype(U64), 1)
    if not len(size):
        return out
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = LOWER[data] if lower else data
    eight = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    rows, at, left = None, starts, size
    for k in range(LONG // 8):
        step = eight[at] & _MASKS[np.minimum(left, 8)]
        if k == 0:
            out = mix(out ^ step)
            rows = np.flatnonzero((left > 8) & (left <= LONG))
            at, left = at[rows], left[rows]
        else:
            out[rows] = mix(out[rows] ^ step)
            more = left > 8
            rows, at, left = rows[more], at[more], left[more]
        if not len(rows):
            break
        at, left = at + 8, left - 8
    for row in np.flatnonzero(size > LONG).tolist():
        out[row] = int.from_bytes(blake2b(padded[starts[row] : ends[row]].tobytes(), digest_size=8).digest(), "little")
    return out


def gram_hashes(values: np.ndarray, n: int) -> np.ndarray:
    """Hashes of every n consecutive values (those over a document's end included; the caller drops them)."""
    if len(values) < n:
        return np.zeros(0, U64)
    m = len(values) - n + 1
    out = np.full(m, U64(n), U64)
    for k in range(n):
        out += values[k : k + m] * MIX[k]
    return mix(out, n)


def shingle_sets(data: np.ndarray, offs: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct k-word shingle hashes of each document, concatenated, and their counts.

    Words are runs of non-space bytes with A-Z folded.  A document of 1 to k-1
    words has one shingle, its whole sequence; one without words has none.
    """
    starts, ends, per_doc = words(data, offs, NOT_SPACE)
    h = span_hashes(data, starts, ends)
    grams = gram_hashes(h, k)
    edge = np.concatenate([[0], np.cumsum(per_doc)])
    sets, counts = [], np.zeros(len(per_doc), np.int64)
    for i, (a, b) in enumerate(zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)):
        if b == a:
            continue
        if b - a < k:
            s = gram_hashes(h[a:b], b - a)
        else:
            s = np.sort(grams[a : b - k + 1])
            if len(s) > 1:
                s = s[np.concatenate([[True], s[1:] != s[:-1]])]
        sets.append(s)
        counts[i] = len(s)
    return (np.concatenate(sets) if sets else np.zeros(0, U64)), counts


def spans(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions start, start+1, ... of every span, one after another."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    keep = lengths > 0
    starts, lengths = starts[keep], lengths[keep]
    step = np.ones(total, np.int64)
    step[0] = starts[0]
    step[np.cumsum(lengths)[:-1]] = starts[1:] - starts[:-1] - lengths[:-1] + 1
    return np.cumsum(step)


def pack(values: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """A binary array whose i-th value has the bytes of values[cuts[i]:cuts[i+1]]."""
    raw = np.ascontiguousarray(values)
    offsets = (np.asarray(cuts, np.int64) * raw.itemsize).astype(np.int64)
    if offsets[-1] >= 2**31:
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(raw)])
    return pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(raw)])


def by_bucket(bucket: np.ndarray, n_buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order that brings the values of a bucket together (stable), the buckets that occur, and their cuts in that order."""
    order = np.argsort(bucket, kind="stable")
    edges = np.searchsorted(bucket[order], np.arange(n_buckets + 1))
    there = np.flatnonzero(np.diff(edges))
    return order, there, np.concatenate([edges[there], edges[-1:]])
