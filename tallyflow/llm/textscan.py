"""Vectorised scans of text columns: words, lines, hashes and character counts.

All functions work on the UTF-8 bytes of an Arrow column.  Words are maximal runs
of bytes other than space and 0x09-0x0D.  Strings are hashed by polynomials modulo the
prime 2^61 - 1 over random byte values, so the hash of any substring is a difference of two
prefix sums times an inverse power.  Modulo a power of two, long regular strings would
agree whatever the base; modulo a prime, two strings of n symbols agree for n bases at most.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa

#: Bytes scanned at a time.
SCAN_BYTES = 1 << 19

U64 = np.uint64
#: Modulus of the hashes, and two independent bases.
PRIME = (1 << 61) - 1
BASES = (0x0B7C93E2D4F16A85, 0x12E9A4C85F3D7B61)
#: Entries multiplied at a time, so that intermediate arrays stay in the cache.
_CACHED = 1 << 14


def mix64(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values (new array)."""
    h = h ^ (h >> U64(30))
    h *= U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


def reduced(x: np.ndarray) -> np.ndarray:
    """``x`` modulo ``PRIME`` for any 64-bit values (new array)."""
    out = x & U64(PRIME)
    out += x >> U64(61)
    # Below the prime, the difference wraps around and is the larger one.
    return np.minimum(out, out - U64(PRIME))


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products modulo ``PRIME`` of values below it (arrays of one length, or ``b`` of length one)."""
    out = np.empty(len(a), dtype=np.uint64)
    half, quarter = U64((1 << 31) - 1), U64((1 << 30) - 1)
    for at in range(0, len(a), _CACHED):
        x = a[at : at + _CACHED]
        y = b[at : at + _CACHED] if len(b) > 1 else b
        x1, x0, y1, y0 = x >> U64(31), x & half, y >> U64(31), y & half
        # 2^62 counts as 2, and 2^61 as 1.
        middle = x1 * y0
        middle += x0 * y1
        total = x0 * y0
        total += (x1 * y1) << U64(1)
        total += middle >> U64(30)
        total += (middle & quarter) << U64(31)
        out[at : at + _CACHED] = reduced(total)
    return out


def small_times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``times`` where ``a`` is below 2^31, below 2^62 and not yet reduced."""
    out = np.empty(len(a), dtype=np.uint64)
    half, quarter = U64((1 << 31) - 1), U64((1 << 30) - 1)
    for at in range(0, len(a), _CACHED):
        x, y = a[at : at + _CACHED], b[at : at + _CACHED]
        middle = x * (y >> U64(31))
        total = x * (y & half)
        total += middle >> U64(30)
        middle &= quarter
        middle <<= U64(31)
        total += middle
        np.bitwise_and(total, U64(PRIME), out=out[at : at + _CACHED])
        out[at : at + _CACHED] += total >> U64(61)
    return out


def sums(values: np.ndarray, carry: int = 0) -> np.ndarray:
    """``len(values) + 1`` prefix sums modulo ``PRIME`` of values below 2^62, the first one ``carry``."""
    out = np.empty(len(values) + 1, dtype=np.uint64)
    out[0] = carry
    half, quarter = U64((1 << 31) - 1), U64((1 << 30) - 1)
    for at in range(0, len(values), _CACHED):
        part = values[at : at + _CACHED]
        total = np.cumsum(part & half)
        high = np.cumsum(part >> U64(31))
        total += high >> U64(30)
        high &= quarter
        high <<= U64(31)
        total += high
        total += out[at]
        out[at + 1 : at + 1 + len(part)] = reduced(total)
    return out


def minus(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differences modulo ``PRIME``."""
    return a + (a < b) * U64(PRIME) - b


def powers(base: int, n: int) -> np.ndarray:
    """base^i for i <= n."""
    out = np.ones(n + 1, dtype=np.uint64)
    have = 1
    while have <= n:
        more = min(have, n + 1 - have)
        out[have : have + more] = times(out[:more], np.array([pow(base, have, PRIME)], dtype=np.uint64))
        have += more
    return out


@cache
def _scan_powers(which: int) -> tuple[np.ndarray, np.ndarray]:
    """base^i and its inverse powers, i <= SCAN_BYTES."""
    base = BASES[which]
    return powers(base, SCAN_BYTES), powers(pow(base, -1, PRIME), SCAN_BYTES)


def _power_arrays(n: int, which: int) -> tuple[np.ndarray, np.ndarray]:
    """At least n + 1 powers and inverse powers of a base."""
    if n <= SCAN_BYTES:
        return _scan_powers(which)
    base = BASES[which]
    return powers(base, n), powers(pow(base, -1, PRIME), n)


@cache
def byte_values(lower: bool) -> np.ndarray:
    """A random value of each byte, below 2^31; with ``lower`` A-Z have the values of a-z."""
    values = mix64(np.arange(1, 257, dtype=np.uint64) * U64(0xD1342543DE82EF95)) >> U64(33)
    if lower:
        values[65:91] = values[97:123]
    return values


def _space_table() -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[[9, 10, 11, 12, 13, 32]] = True
    return table


SPACE = _space_table()


def substring_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Hashes of ``data[starts[i]:ends[i]]``; the same bytes give the same hash anywhere.

    Starts and ends ascend.  Prefix sums exist for ``SCAN_BYTES`` at a time.
    """
    power, inverse = _scan_powers(0)
    out = np.zeros(len(starts), dtype=np.uint64)
    carry, shift, a, b = 0, 1, 0, 0
    step = int(power[SCAN_BYTES])
    for at in range(0, max(len(data), 1), SCAN_BYTES):
        part = data[at : at + SCAN_BYTES]
        terms = small_times(values[part], power[: len(part)])
        if at:
            shift = shift * step % PRIME
            terms = times(reduced(terms), np.array([shift], dtype=np.uint64))
        prefix = sums(terms, carry)
        last = at + len(part)
        a_to = int(np.searchsorted(starts, last, side="right"))
        b_to = int(np.searchsorted(ends, last, side="right"))
        out[a:a_to] = minus(out[a:a_to], prefix[starts[a:a_to] - at])
        out[b:b_to] = reduced(out[b:b_to] + prefix[ends[b:b_to] - at])
        carry, a, b = int(prefix[-1]), a_to, b_to
    out = times(out, inverse[starts % SCAN_BYTES])
    if len(data) > SCAN_BYTES:
        back = int(inverse[SCAN_BYTES])
        far = [pow(back, k, PRIME) for k in range(len(data) // SCAN_BYTES + 1)]
        out = times(out, np.array(far, dtype=np.uint64)[starts // SCAN_BYTES])
    return mix64(out + (ends - starts).astype(np.uint64))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the n + 1 offsets into them; null counts as empty."""
    column = column.cast(pa.large_string()).fill_null("")
    if column.offset:
        column = pa.concat_arrays([column])
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(column: pa.Array, most: int = SCAN_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of consecutive rows with up to ``most`` bytes, one row at least."""
    data, offsets = utf8(column)
    row, n = 0, len(offsets) - 1
    while row < n:
        end = int(np.searchsorted(offsets, offsets[row] + most, side="right")) - 1
        end = min(n, max(end, row + 1))
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words; a word never crosses an offset."""
    inside = ~SPACE[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    before = np.concatenate(([False], inside))
    after = np.concatenate((inside, [False]))
    starts = np.flatnonzero(after & (~before | edge))
    ends = np.flatnonzero(before & (~after | edge))
    return starts, ends


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word, and the n + 1 offsets of the rows into them."""
    starts, ends = word_spans(data, offsets)
    return substring_hashes(data, starts, ends, byte_values(lower)), np.searchsorted(starts, offsets)


def range_hashes(
    values: np.ndarray, first: np.ndarray, last: np.ndarray, without: np.ndarray | None = None, which: int = 0
) -> np.ndarray:
    """Hashes of the sequences ``values[first:last]``, leaving out entry ``without`` where that is in the range.

    ``which`` names one of two independent bases.
    """
    power, inverse = _power_arrays(len(values), which)
    prefix = sums(times(reduced(values), power[: len(values)]))
    length = last - first
    total = minus(prefix[last], prefix[first])
    if without is not None:
        inside = without >= first
        cut = np.where(inside, without, first)
        behind = times(minus(prefix[last], prefix[np.minimum(cut + 1, last)]), inverse[1:2])
        total = np.where(inside, reduced(minus(prefix[cut], prefix[first]) + behind), total)
        length = length - inside
    return mix64(times(total, inverse[first]) + length.astype(np.uint64))


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of ``width`` words: entry i covers words i .. i + width - 1."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    for j in range(width):
        out *= U64(0xA0761D6478BD642F)
        out += words[j : j + n]
    return mix64(out + U64(width))


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int = 5) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of every row, words lower-cased in ASCII.

    A row with fewer than ``width`` words has its whole sequence as its one shingle;
    a row without words has none.
    """
    words, rows = word_hashes(data, offsets, lower=True)
    windows = window_hashes(words, width)
    out = []
    for a, b in zip(rows[:-1].tolist(), rows[1:].tolist(), strict=True):
        if b - a >= width:
            out.append(np.unique(windows[a : b - width + 1]))
        elif b > a:
            out.append(window_hashes(words[a:b], b - a))
        else:
            out.append(words[:0])
    return out
