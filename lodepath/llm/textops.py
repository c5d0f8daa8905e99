"""Vectorised text primitives on Arrow buffers: word spans, 64-bit word hashes, shingle sets.

Words are runs of bytes other than 0x20 and 0x09-0x0D, with A-Z lower-cased; UTF-8 bytes above 0x7F are
never separators, so byte and character views agree. Hashes are 64-bit: two different words of a corpus
of 1e9 distinct words share one with a chance of about 3 %, two sets of shingles practically never.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
MASK = (1 << 64) - 1
SLICE = 1 << 20
_R = 0x9E3779B97F4A7C15 | 1
_M1, _M2 = U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (splitmix64's finaliser)."""
    x = x ^ (x >> U(30))
    x = x * _M1
    x ^= x >> U(27)
    x *= _M2
    x ^= x >> U(31)
    return x


def _bytes_table() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=U) * U(_R))


_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """r**i and r**-i modulo 2**64 for i < n."""
    if len(_powers.get("p", ())) < n:
        size = max(n, SLICE + 1)
        inverse = pow(_R, -1, 1 << 64)
        for k, r in (("p", _R), ("i", inverse)):
            a = np.full(size, r, dtype=U)
            a[0] = 1
            _powers[k] = np.cumprod(a, dtype=U)
        _powers["t"] = _bytes_table()
    return _powers["p"], _powers["i"]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and 64-bit offsets of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_string())
    _, offs, data = column.buffers()
    o = np.frombuffer(offs, np.int64)[column.offset : column.offset + len(column) + 1]
    d = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return d, o


def slices(column: pa.Array, limit: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of runs of rows of about `limit` bytes; a longer row is alone."""
    if not len(column):
        return
    data, offs = buffers(column)
    lo, n = 0, len(offs) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, side="right")) - 1)
        hi = min(hi, n)
        yield lo, hi, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


def words(data: np.ndarray, offs: np.ndarray, apart: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, start, end and hash of each word, in order of the text; apart: which bytes separate."""
    n = len(data)
    if not n:
        e = np.zeros(0, np.int64)
        return e, e, e, e.astype(U)
    space = apart[data]
    edge = np.zeros(n + 1, bool)
    edge[offs] = True
    before = np.empty(n, bool)
    before[0] = True
    before[1:] = space[:-1]
    before |= edge[:n]
    after = np.empty(n, bool)
    after[-1] = True
    after[:-1] = space[1:] | edge[1:n]
    starts = np.flatnonzero(~space & before)
    ends = np.flatnonzero(~space & after) + 1
    h = spans_hash(LOWER[data], starts, ends)
    return np.searchsorted(offs, starts, side="right") - 1, starts, ends, h


def spans_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes, from prefix sums of a polynomial over random byte values."""
    p, inv = powers(len(data) + 1)
    total = np.empty(len(data) + 1, U)
    total[0] = 0
    np.cumsum(_powers["t"][data] * p[: len(data)], out=total[1:])
    h = (total[ends] - total[starts]) * inv[starts]
    return mix(h + (ends - starts).astype(U) * U(_R))


def shingle_sets(rows: int, doc: np.ndarray, h: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, hash) of k-word shingles, sorted; fewer than k words make one shingle, none make none."""
    return sized_shingle_sets(rows, doc, h, k, np.zeros(len(h), np.int64))[:2]


def sized_shingle_sets(rows: int, doc: np.ndarray, h: np.ndarray, k: int, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """shingle_sets(), and the bytes that each shingle's words have, `size` being each word's."""
    counts = np.bincount(doc, minlength=rows)
    n = len(h)
    parts_d, parts_h, parts_s = [], [], []
    if n >= k:
        acc = np.zeros(n - k + 1, U)
        for j in range(k):
            acc += mix(h[j : n - k + 1 + j] + U((j + 1) * _R & MASK))
        same = doc[: n - k + 1] == doc[k - 1 :]
        parts_d.append(doc[: n - k + 1][same])
        parts_h.append(mix(acc[same] + U(k)))
        total = np.r_[0, np.cumsum(size)]
        parts_s.append((total[k:] - total[:-k])[same])
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        inside = np.isin(doc, short)
        d, x = doc[inside], h[inside]
        first = np.r_[True, d[1:] != d[:-1]]
        at = np.arange(len(d)) - np.maximum.accumulate(np.where(first, np.arange(len(d)), 0))
        v = np.add.reduceat(mix(x + (at + 1).astype(U) * U(_R)), np.flatnonzero(first))
        parts_d.append(d[first])
        parts_h.append(mix(v + counts[d[first]].astype(U)))
        parts_s.append(np.add.reduceat(size[inside], np.flatnonzero(first)))
    if not parts_d:
        return np.zeros(0, np.int64), np.zeros(0, U), np.zeros(0, np.int64)
    d, x, s = np.concatenate(parts_d), np.concatenate(parts_h), np.concatenate(parts_s)
    order = np.lexsort((x, d))
    d, x, s = d[order], x[order], s[order]
    new = np.r_[True, (d[1:] != d[:-1]) | (x[1:] != x[:-1])] if len(d) else np.zeros(0, bool)
    return d[new], x[new], s[new]


def signed(x: np.ndarray) -> pa.Array:
    """64-bit hashes as Spark's bigint."""
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def lists(values: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """A list column from flat values and each row's length."""
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(lengths)].astype(np.int32)), pa.array(values))
