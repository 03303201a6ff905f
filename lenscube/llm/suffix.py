"""Suffix arrays in numpy: Larsson-Sadakane refinement and Kasai's common prefixes."""

from __future__ import annotations

import numpy as np


def _packed(data: np.ndarray, little: bool) -> np.ndarray:
    """The 8 bytes from each position as one number; zeros follow the end."""
    wide = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint64)
    for step in (1, 2, 4):
        ahead = wide[step:]
        wide = wide[:-step] | ahead << np.uint64(8 * step) if little else wide[:-step] << np.uint64(8 * step) | ahead
    return wide[: len(data)]


def suffix_array(data: np.ndarray) -> np.ndarray:
    """The suffixes of ``data`` (uint8) in order; one that ends comes before one that goes on.

    Ranks by eight bytes are refined by doubling: the rank of the suffix h further on is the second key, and
    only groups that are not yet single are sorted again.
    """
    n = len(data)
    first = _packed(data, little=False)
    order = np.argsort(first, kind="stable").astype(np.int64)
    new = np.concatenate(([True], first[order[1:]] != first[order[:-1]]))[:n]
    rank = np.empty(n, np.int64)
    rank[order] = np.flatnonzero(new)[np.cumsum(new) - 1] if n else order
    single = new & np.append(new[1:], True) if n else new
    todo = np.flatnonzero(~single)  # places in ``order`` whose groups are open
    h = 8
    while len(todo):
        at = order[todo]
        ahead = np.where(at + h < n, rank[np.minimum(at + h, n - 1)] + n + 1, n - at)  # of those that end, the shorter first
        own = rank[at]
        key = own * (2 * n + 2) + ahead
        by = np.argsort(key, kind="stable")
        order[todo] = at = at[by]
        key = key[by]
        new = np.concatenate(([True], key[1:] != key[:-1]))
        rank[at] = todo[np.flatnonzero(new)[np.cumsum(new) - 1]]
        single = new & np.append(new[1:], True)
        todo = todo[~single]
        h *= 2
    return order


def common_prefixes(data: np.ndarray, order: np.ndarray, most: int, lane: int = 256) -> np.ndarray:
    """For each place in ``order``, the common prefix with the place before, up to ``most``; 0 at the first.

    Kasai's walk in text order, where a prefix shrinks by one at most from one position to the next; lanes
    of the text walk side by side.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    eight = np.concatenate([_packed(data, little=True), np.zeros(most + 16, np.uint64)])
    out = np.zeros(n, np.int64)
    starts = np.arange(0, n, lane)
    length = np.zeros(len(starts), np.int64)
    for t in range(lane):
        i = starts + t
        live = i < n
        i, length = i[live], length[live]
        starts = starts[live]
        length = np.maximum(length - 1, 0)
        j = before[i]
        length[j < 0] = 0
        open_ = np.flatnonzero((j >= 0) & (length < most))
        while len(open_):
            a, b, l = i[open_], j[open_], length[open_]
            differ = eight[a + l] ^ eight[b + l]
            zero = differ == 0
            low = differ & (~differ + np.uint64(1))
            same = np.where(zero, 8, np.bitwise_count(low - np.uint64(1)).astype(np.int64) >> 3)
            length[open_] = np.minimum(np.minimum(l + same, most), n - np.maximum(a, b))
            open_ = open_[zero & (length[open_] < most) & (l + 8 <= n - np.maximum(a, b))]
        out[i] = length
    return out[order]
