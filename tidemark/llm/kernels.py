"""Vectorised text kernels used inside Arrow tasks: words, shingles, hashes and SimHash bits.

All of them work on the UTF-8 bytes of a few documents at a time (``blocks``), so the memory of a
task is bounded by the block size or by its longest single document, never by its partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
BLOCK_BYTES = 1 << 20
_MULT = 0x9E3779B97F4A7C15 | 1
_INV = pow(_MULT, -1, 1 << 64)
_STEP = 0xD6E8FEB86659FD93
_LANES = U64(0x0101010101010101)

#: Bytes that separate words: space, tab to carriage return.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_BYTE = mix(np.arange(1, 257, dtype=U64) * U64(_MULT))
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], U64)
_powers = {"p": np.empty(0, U64), "q": np.empty(0, U64)}


def _pow(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers["p"]) < n:
        n = max(n, 2 * BLOCK_BYTES)
        for key, base in (("p", _MULT), ("q", _INV)):
            x = np.full(n, base, U64)
            x[0] = 1
            _powers[key] = np.cumprod(x, dtype=U64)
    return _powers["p"], _powers["q"]


def utf8(column: pa.Array, empty: str | bytes = "") -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column (or binary, with ``empty`` as bytes) and its offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null(empty).cast(pa.large_binary())
    if len(column) == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = column.buffers()
    off = np.frombuffer(off, np.int64)[column.offset : column.offset + len(column) + 1]
    buf = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return buf[off[0] : off[-1]], off - off[0]


def blocks(off: np.ndarray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about ``limit`` bytes; a longer document stands alone."""
    i, n = 0, len(off) - 1
    while i < n:
        j = int(np.searchsorted(off, off[i] + limit, "right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def spans(buf: np.ndarray, off: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and each document's range of words."""
    if len(buf) == 0:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(off), np.int64)
    ok = ~space[buf]
    first = ok.copy()
    first[1:] &= ~ok[:-1]
    begin = off[:-1][off[:-1] < off[1:]]
    first[begin] = ok[begin]
    last = ok.copy()
    last[:-1] &= ~ok[1:] | first[1:]
    start = np.flatnonzero(first)
    return start, np.flatnonzero(last) + 1, np.searchsorted(start, off)


def word_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span, from prefix sums of a polynomial in the bytes."""
    if len(start) == 0:
        return np.empty(0, U64)
    p, q = _pow(len(buf) + 1)
    total = np.empty(len(buf) + 1, U64)
    total[0] = 0
    np.cumsum(_BYTE[buf] * p[: len(buf)], out=total[1:])
    return mix((total[end] - total[start]) * q[start] + (end - start).astype(U64))


def distinct_spans(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A first span of each distinct one, and each span's place among these.

    Spans are told apart by their hashes, and the bytes are compared as well: if two different spans
    have one hash, all spans of the block are told apart by their bytes.
    """
    if len(start) == 0:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    _, first, code = np.unique(word_hashes(buf, start, end), return_index=True, return_inverse=True)
    n, like = end - start, first[code]
    eight = np.ndarray(len(buf) + 1, "<u8", np.concatenate([buf, np.zeros(8, np.uint8)]), strides=(1,))
    mask = _MASKS[np.minimum(n, 8)]
    same = n == n[like]
    for at in (start, np.maximum(end - 8, start)):
        part = eight[at] & mask
        same &= part == part[like]
    raw = None
    for k in np.flatnonzero(same & (n > 16) & (like != np.arange(len(n)))).tolist():
        raw = raw or buf.tobytes()
        same[k] = raw[start[k] : end[k]] == raw[start[like[k]] : end[like[k]]]
    if not same.all():
        raw, known = buf.tobytes(), {}
        code = np.array([known.setdefault(raw[a:b], len(known)) for a, b in zip(start.tolist(), end.tolist(), strict=True)], np.int64)
        _, first = np.unique(code, return_index=True)
    return first, code


def shingle_hashes(words: np.ndarray, wo: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each document's k-word shingles in order, repeats included, and their offsets.

    A document of fewer words has one shingle, its whole sequence; one of none has none.
    """
    n = np.diff(wo)
    count = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    so = np.concatenate([[0], np.cumsum(count)])
    if so[-1] == 0:
        return np.empty(0, U64), so
    doc = np.repeat(np.arange(len(n)), count)
    at = wo[:-1][doc] + np.arange(so[-1]) - so[:-1][doc]
    out = np.zeros(so[-1], U64)
    weight = 1
    for i in range(k):
        there = at + i < wo[1:][doc]
        out += np.where(there, words[np.minimum(at + i, len(words) - 1)], U64(0)) * U64(weight)
        weight = weight * _STEP & (2**64 - 1)
    return mix(out), so


def bit_counts(h: np.ndarray, so: np.ndarray) -> np.ndarray:
    """For each document the number of its hashes that have each of the 64 bits.

    Eight byte lanes are summed at once, at most 255 hashes at a time, so no lane overflows.
    """
    count = np.diff(so)
    out = np.zeros((len(count), 64), np.int64)
    full = np.flatnonzero(count)
    if len(full) == 0:
        return out
    parts = (count[full] + 254) // 255
    po = np.concatenate([[0], np.cumsum(parts)])
    at = np.repeat(so[:-1][full], parts) + 255 * (np.arange(po[-1]) - np.repeat(po[:-1], parts))
    for k in range(8):
        lanes = np.add.reduceat((h >> U64(k)) & _LANES, at)
        sums = np.add.reduceat(lanes.astype("<u8").view(np.uint8).reshape(-1, 8).astype(np.int64), po[:-1], axis=0)
        out[full, k::8] = sums
    return out


def pack_bits(on: np.ndarray) -> np.ndarray:
    """Rows of 64 booleans, bit 0 first, as unsigned integers."""
    return np.packbits(on, axis=1, bitorder="little").view("<u8").reshape(-1)


def simhash(h: np.ndarray, so: np.ndarray) -> np.ndarray:
    """A bit is 1 if more than half of the document's hashes have it; without hashes it is 0."""
    return pack_bits(2 * bit_counts(h, so) > np.diff(so)[:, None])


def doc_shingles(column: pa.Array, k: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For each block of documents: its range, lower-cased k-word shingle hashes and offsets."""
    buf, off = utf8(column)
    for i, j in blocks(off):
        part, o = LOWER[buf[off[i] : off[j]]], off[i : j + 1] - off[i]
        start, end, wo = spans(part, o)
        h, so = shingle_hashes(word_hashes(part, start, end), wo, k)
        yield i, j, h, so
