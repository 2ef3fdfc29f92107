"""Vectorised word hashing over Arrow string columns.

Words are maximal runs of bytes outside a separator set, found in UTF-8, so a code point of two or more bytes is never
split. A word's hash is a polynomial over per-byte random values modulo 2**64, mixed with its length; runs of words are
hashed by a second polynomial. All temporaries are bounded by CHUNK bytes of text, whatever a document's length.
"""

from __future__ import annotations

import ctypes
import sys

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20
SPACE = bytes([9, 10, 11, 12, 13, 32])
_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_RUN = np.uint64(0xD6E8FEB86659FD93)
_MASK = (1 << 64) - 1
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def table(separators: bytes, lower: bool) -> np.ndarray:
    """256 values: a space for separators, a-z for A-Z if lower, else the byte itself."""
    out = np.arange(256, dtype=np.uint8)
    if lower:
        out[65:91] += 32
    out[list(separators)] = 32
    return out


SPACED = table(SPACE, False)
SPACED_LOWER = table(SPACE, True)
ALNUM_LOWER = table(bytes([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]), True)


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2**64, for n places at least."""
    size = CHUNK
    while size < n:
        size *= 2
    if size not in _powers:
        _powers.clear()

        def made(base: int) -> np.ndarray:
            out = np.empty(size, np.uint64)
            out[0], have, step = 1, 1, base
            while have < size:
                np.multiply(out[:have], np.uint64(step), out=out[have : 2 * have])
                have, step = 2 * have, step * step & _MASK
            return out

        _powers[size] = made(_BASE), made(pow(_BASE, -1, 1 << 64))
    return _powers[size]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (one more than rows) of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), offsets


def release() -> None:
    """Give memory that a batch has freed back to the system, as workers live on and share a budget with their executor."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        ctypes.CDLL(None).malloc_trim(0)


def slices(batch: pa.RecordBatch, column: int, limit: int = 8 << 20):
    """The batch in pieces of about `limit` bytes of a string column at most (a longer text alone), without copying."""
    _, offsets = utf8(batch.column(column))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to
    release()


def _cuts(data: np.ndarray, lo: int, hi: int, bytes_as: np.ndarray) -> list[int]:
    """Places from lo to hi, about CHUNK apart, each before a separator (or at an end)."""
    cuts = [lo]
    while hi - cuts[-1] > CHUNK:
        at = cuts[-1] + CHUNK
        window = bytes_as[data[cuts[-1] + 1 : at]] == 32
        back = int(window[::-1].argmax())
        if window.size and window[len(window) - 1 - back]:
            cuts.append(at - 1 - back)
            continue
        while at < hi and bytes_as[data[at]] != 32:
            at += 1
        cuts.append(at)
    return cuts if cuts[-1] == hi else [*cuts, hi]


def words(data: np.ndarray, offsets: np.ndarray, bytes_as: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first byte and end byte of each word in order, and for each document the index of its first word (one more than rows)."""
    lo, hi = int(offsets[0]), int(offsets[-1])
    hashes, starts, ends = [], [], []
    cuts = _cuts(data, lo, hi, bytes_as)
    for a, b in zip(cuts, cuts[1:]):
        part = bytes_as[data[a:b]]
        inside = part != 32
        n = b - a
        edge = np.zeros(n + 1, bool)
        own = offsets[np.searchsorted(offsets, a) : np.searchsorted(offsets, b, "right")]
        edge[own - a] = True
        edge[0] = edge[n] = True
        first = inside.copy()
        first[1:] &= ~inside[:-1] | edge[1:n]
        last = inside.copy()
        last[:-1] &= ~inside[1:] | edge[1:n]
        s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
        power, inverse = _power(n + 1)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[part] * power[:n], out=total[1:])
        h = (total[e] - total[s]) * inverse[s]
        hashes.append(mix(h + (e - s).astype(np.uint64) * np.uint64(0xA24BAED4963EE407)))
        starts.append(s + a)
        ends.append(e + a)
    empty = np.zeros(0, np.int64)
    start = np.concatenate(starts) if starts else empty
    return np.concatenate(hashes) if hashes else empty.astype(np.uint64), start, np.concatenate(ends) if ends else empty, np.searchsorted(start, offsets)


def runs(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each word on (len - k + 1 values); a run may cross documents, which callers mask."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = hashes[:n].copy()
    for j in range(1, k):
        out *= _RUN
        out += hashes[j : j + n]
    return mix(out)


def run_starts(first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Word indexes at which a run of k words stays within one document, and the documents' counts of such runs."""
    counts = np.maximum(np.diff(first) - k + 1, 0)
    return spread(first[:-1], counts), counts


def spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start + 1, ... count times for each pair."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    base = np.repeat(starts - np.r_[0, np.cumsum(counts)[:-1]], counts)
    return base + np.arange(total)


def sequence_hash(hashes: np.ndarray) -> int:
    """One hash of a whole word sequence of any length."""
    value = 0
    for h in hashes.tolist():
        value = (value * int(_RUN) + h) & _MASK
    return int(mix(np.array([value ^ len(hashes)], np.uint64))[0])
