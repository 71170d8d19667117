"""Suffix arrays by induced sorting and permuted common prefixes, for many strings in step.

Induced sorting is sequential within one string, so numpy runs it over a matrix with one string ("lane") per column:
step t of every lane is one set of array operations. All work is linear in the size of the matrix.
"""

from __future__ import annotations

import numpy as np


def _types(text: np.ndarray) -> np.ndarray:
    """True where the suffix is smaller than the next one (S type); the sentinel in the last row is S."""
    n, k = text.shape
    sign = np.ones((n, k), np.int8)
    sign[:-1] = np.sign(text[1:] - text[:-1])
    at = np.where(sign != 0, np.arange(n, dtype=np.int32)[:, None], n)
    at = np.minimum.accumulate(at[::-1], axis=0)[::-1]  # next row where the symbol changes
    return np.take_along_axis(sign, at, 0) > 0


def _bounds(text: np.ndarray, sigma: int) -> tuple[np.ndarray, np.ndarray]:
    """First slot and end of each symbol's bucket, as (sigma, lanes)."""
    n, k = text.shape
    counts = np.bincount((text.astype(np.int64) * k + np.arange(k)).ravel(), minlength=sigma * k).reshape(sigma, k)
    ends = np.cumsum(counts, axis=0)
    return ends - counts, ends


def _induce(coded: np.ndarray, sa: np.ndarray, heads: np.ndarray, ends: np.ndarray) -> None:
    """From the leftmost-smaller suffixes in ``sa`` induce the larger types rightwards, then the smaller leftwards.

    ``coded`` holds 2 * symbol + type.
    """
    n, k = sa.shape
    flat, slots = coded.ravel(), sa.ravel()
    head = heads.ravel().copy()
    for t in range(n):
        j = sa[t].astype(np.int64) - 1
        on = np.flatnonzero(j >= 0)
        j = j[on]
        code = flat[j * k + on]
        keep = np.flatnonzero((code & 1) == 0)
        on, j, bucket = on[keep], j[keep], (code[keep] >> 1) * k + on[keep]
        slot = head[bucket]
        slots[slot * k + on] = j
        head[bucket] = slot + 1
    tail = ends.ravel().copy()
    for t in range(n - 1, -1, -1):
        j = sa[t].astype(np.int64) - 1
        on = np.flatnonzero(j >= 0)
        j = j[on]
        code = flat[j * k + on]
        keep = np.flatnonzero(code & 1)
        on, j, bucket = on[keep], j[keep], (code[keep] >> 1) * k + on[keep]
        slot = tail[bucket] - 1
        slots[slot * k + on] = j
        tail[bucket] = slot


def _placed(order: np.ndarray, lanes: np.ndarray, coded: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A fresh array with the given suffixes, in the given order within each bucket, at their buckets' ends."""
    n, k = coded.shape
    sa = np.full((n, k), -1, np.int32)
    bucket = (coded[order, lanes] >> 1).astype(np.int64) * k + lanes
    by = np.argsort(bucket, kind="stable")
    b = bucket[by]
    last = np.searchsorted(b, b, side="right")
    slot = ends.ravel()[b] - (last - np.arange(len(b)))
    sa[slot, lanes[by]] = order[by]
    return sa


def suffix_arrays(text: np.ndarray, sigma: int) -> np.ndarray:
    """Suffix array of every column of ``text`` (symbols 0..sigma-1).

    The last row must be 0, a sentinel that occurs nowhere else in the column.
    """
    n, k = text.shape
    if n == 1:
        return np.zeros((1, k), np.int32)
    small = _types(text)
    leftmost = small.copy()
    leftmost[0] = False
    leftmost[1:] &= ~small[:-1]
    coded = text.astype(np.int32) * 2 + small
    heads, ends = _bounds(text, sigma)
    lanes, rows = np.nonzero(leftmost.T)  # lane by lane, in text order
    sa = _placed(rows, lanes, coded, ends)
    _induce(coded, sa, heads, ends)
    # Names of the leftmost-smaller substrings in sorted order.
    lane_of, slot = np.nonzero(leftmost[sa.T, np.arange(k)[:, None]])
    at = sa[slot, lane_of]
    differs = np.ones(len(at), bool)
    active = np.flatnonzero(lane_of[1:] == lane_of[:-1]) + 1
    step = 0
    while len(active):
        a, b, lane = at[active] + step, at[active - 1] + step, lane_of[active]
        inside = (a < n) & (b < n)
        a, b = np.minimum(a, n - 1), np.minimum(b, n - 1)
        same = inside & (coded[a, lane] == coded[b, lane])
        end = same & (step > 0) & leftmost[a, lane] & leftmost[b, lane]
        same &= ~((step > 0) & (leftmost[a, lane] ^ leftmost[b, lane]))
        differs[active[end]] = False
        active = active[same & ~end]
        step += 1
    count = np.bincount(lanes, minlength=k)
    begin = np.cumsum(count) - count
    rank = np.cumsum(differs)
    rank = rank - rank[begin][lane_of]  # from 0 in each lane
    if differs.all():
        order, order_lane = at, lane_of
    else:
        most = int(count.max())
        top = int(rank.max()) + 1
        name = np.zeros((n, k), np.int32)
        name[at, lane_of] = rank
        short = np.full((most, k), top, np.int32)  # shorter lanes are padded in front with the largest symbol
        place = most - count[lanes] + (np.arange(len(lanes)) - begin[lanes])
        short[place, lanes] = name[rows, lanes]
        inner = suffix_arrays(short, top + 1)
        where = np.zeros((most, k), np.int32)
        where[place, lanes] = rows
        order_lane, slot = np.nonzero((inner >= (most - count)).T)
        order = where[inner[slot, order_lane], order_lane]
    sa = _placed(order, order_lane, coded, ends)
    _induce(coded, sa, heads, ends)
    return sa


def common_prefixes(text: np.ndarray, sa: np.ndarray, most: int) -> np.ndarray:
    """Permuted common prefixes: for each row (in text order) the length that its suffix shares with its predecessor
    in the suffix array, up to ``most``. Each lane extends or advances at every step, at most about 2n steps."""
    n, k = text.shape
    lane = np.arange(k)
    before = np.full((n, k), -1, np.int32)
    before[sa[1:], lane] = sa[:-1]
    out = np.zeros((n, k), np.int32)
    at, length = np.zeros(k, np.int64), np.zeros(k, np.int64)
    flat, prev, res = text.ravel(), before.ravel(), out.ravel()
    live = lane.copy()
    while len(live):
        i, h = at[live], length[live]
        other = prev[i * k + live].astype(np.int64)
        x, y = i + h, other + h
        more = (other >= 0) & (h < most) & (x < n) & (y < n)
        grows = np.zeros(len(live), bool)
        m = np.flatnonzero(more)
        grows[m] = flat[x[m] * k + live[m]] == flat[y[m] * k + live[m]]
        stop = np.flatnonzero(~grows)
        res[i[stop] * k + live[stop]] = h[stop]
        length[live] = np.where(grows, h + 1, np.maximum(h - 1, 0))
        at[live[stop]] += 1
        live = live[at[live] < n]
    return out
