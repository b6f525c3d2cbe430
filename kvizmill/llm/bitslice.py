"""Hamming distances of many bitmaps at once, by bit-sliced counting.

The bitmaps of 64 rows form a block: bit p of all of them is one machine word,
a plane. A query is compared with a whole block by one exclusive-or per plane;
the 64 distances are counted in vertical counters, four planes at a time by
carry-save adders. Counters start so high that a distance beyond the radius
carries out of the top; a block all of whose rows did is abandoned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Pairs of query and block that are worked on together, to stay in the cache.
_CHUNK = 1 << 14


def planes_of(bits: np.ndarray) -> np.ndarray:
    """Planes x blocks of uint64 from a 0/1 array of rows x planes."""
    rows, planes = bits.shape
    padded = np.zeros((-(-max(rows, 1) // 64) * 64, planes), dtype=np.uint8)
    padded[:rows] = bits
    return np.ascontiguousarray(np.packbits(padded.T, axis=1, bitorder="little")).view("<u8")


def _below(k: np.ndarray) -> np.ndarray:
    """Words whose lowest k bits are set, k from 0 to 64."""
    k = k.astype(np.uint64)
    return np.where(k >= 64, _ALL, (np.uint64(1) << np.minimum(k, np.uint64(63))) - np.uint64(1))


def _near(planes, query_bits, query, block, lanes, radius) -> np.ndarray:
    """For pairs of query and block: the lanes whose distance is at most the radius."""
    width = max(1, int(radius.max())).bit_length()
    start = (1 << width) - 1 - radius
    counter = [np.where((start >> k) & 1, _ALL, np.uint64(0)) for k in range(max(width, 2))]
    if width == 1:  # the second counter bit is beyond the top: leave room for it
        counter[1][:] = _ALL
    over, out = ~lanes, np.zeros(len(query), dtype=np.uint64)
    alive = np.arange(len(query))
    for p in range(0, len(planes), 4):
        a, b, c, d = (planes[p + k][block] ^ -query_bits[p + k][query] for k in range(4))
        ones, twos = counter[0], counter[1]
        x = ones ^ a
        carry1 = (ones & a) | (x & b)
        ones = x ^ b
        x = ones ^ c
        carry2 = (ones & c) | (x & d)
        counter[0] = x ^ d
        x = twos ^ carry1
        carry = (twos & carry1) | (x & carry2)
        counter[1] = x ^ carry2
        for k in range(2, len(counter)):
            counter[k], carry = counter[k] ^ carry, counter[k] & carry
        over |= carry
        if p % 16 == 12:
            left = over != _ALL
            if left.sum() < 0.75 * len(left):
                alive, query, block, over = alive[left], query[left], block[left], over[left]
                counter = [c[left] for c in counter]
                if not len(alive):
                    return out
    out[alive] = ~over
    return out


def close_pairs(bits: np.ndarray, size: np.ndarray, group: np.ndarray, share: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs i < j of one group whose bitmaps differ in at most ``share`` of their sizes' sum.

    Rows of a group are neighbours. The radius of a block follows its largest
    row, so a pair may come out that is a little beyond its own radius; no pair
    within it is left out.
    """
    n, width = bits.shape
    if n < 2:
        return
    planes = planes_of(bits)
    query_bits = np.ascontiguousarray(bits.T).astype(np.uint64)
    ends = np.flatnonzero(np.diff(group, append=group[-1] + 1)) + 1
    end = ends[np.searchsorted(ends, np.arange(n), side="right")]
    first, last = (np.arange(n) + 1) // 64, (end - 1) // 64
    blocks = np.where(np.arange(n) + 1 < end, last - first + 1, 0)
    padded = np.zeros(planes.shape[1] * 64, dtype=np.int64)
    padded[:n] = size
    largest = padded.reshape(-1, 64).max(axis=1)
    done = np.concatenate([[0], np.cumsum(blocks)])
    for begin in range(0, int(done[-1]), _CHUNK):
        k = np.arange(begin, min(begin + _CHUNK, int(done[-1])))
        query = np.searchsorted(done, k, side="right") - 1
        block = first[query] + k - done[query]
        lanes = _below(np.clip(end[query] - 64 * block, 0, 64)) & ~_below(np.clip(query + 1 - 64 * block, 0, 64))
        radius = np.minimum((share * (size[query] + largest[block])).astype(np.int64), width)
        near = _near(planes, query_bits, query, block, lanes, radius)
        hit = np.flatnonzero(near)
        if len(hit):
            pair, lane = np.nonzero(np.unpackbits(near[hit].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
            yield query[hit][pair], block[hit][pair] * 64 + lane
