"""Suffix arrays of byte shards by induced sorting, and permuted common prefixes, with numpy.

Suffixes are classified as smaller or larger than their successor; leftmost-smaller substrings are
sorted by one induction and named; the names' order is found by naming pairs of names recursively
until they differ or reach the depth asked for; a second induction then fills the whole array.
An induction scans buckets, not single entries: all suffixes that stand in a bucket induce at once,
and those they put into the same bucket are a further round, so the work is linear in the shard.
"""

from __future__ import annotations

import numpy as np


def classify(text: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than its successor. text is closed by a unique smallest 0."""
    # All suffixes in a run of equal characters are of the type of the run's last one.
    last = np.flatnonzero(np.r_[text[:-1] != text[1:], True])
    of_run = np.r_[text[last[:-1]] < text[last[:-1] + 1], True]
    return np.repeat(of_run, np.diff(np.r_[-1, last]))


def _append(sa: np.ndarray, found: np.ndarray, chars: np.ndarray, edge: np.ndarray, down: bool) -> None:
    """Put suffixes at the growing edges of their buckets, in order."""
    order = np.argsort(chars, kind="stable")
    found, chars = found[order], chars[order]
    first = np.flatnonzero(np.r_[True, chars[1:] != chars[:-1]])
    sizes = np.diff(np.r_[first, len(chars)])
    within = np.arange(len(chars)) - np.repeat(first, sizes)
    base = np.repeat(edge[chars[first]], sizes)
    sa[base - 1 - within if down else base + within] = found
    edge[chars[first]] += -sizes if down else sizes


def induce(text: np.ndarray, smaller: np.ndarray, leftmost: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The array that the leftmost-smaller suffixes, in the order given, induce."""
    n, alphabet = len(text), len(bounds) - 1
    sa = np.full(n, -1, np.int32)
    # Leftmost-smaller suffixes stand at the ends of their buckets for the first scan.
    chars = text[leftmost]
    tails = bounds[1:].copy()
    _append(sa, leftmost[::-1], chars[::-1], tails, down=True)
    heads = bounds[:-1].copy()
    for c in range(alphabet):
        at = bounds[c]
        blocks = [(tails[c], bounds[c + 1])]
        while True:
            if heads[c] > at:
                part = sa[at : heads[c]]
                at = heads[c]
            elif blocks:
                low, high = blocks.pop()
                part = sa[low:high]
            else:
                break
            before = part[part > 0] - 1
            before = before[~smaller[before]]
            if len(before):
                _append(sa, before, text[before], heads, down=False)
    # Second scan, from the largest bucket down: smaller suffixes, the leftmost ones anew.
    tails = bounds[1:].copy()
    for c in range(alphabet - 1, -1, -1):
        at = bounds[c + 1]
        blocks = [(bounds[c], heads[c])]
        while True:
            if tails[c] < at:
                part = sa[tails[c] : at][::-1]
                at = tails[c]
            elif blocks:
                low, high = blocks.pop()
                part = sa[low:high][::-1]
            else:
                break
            before = part[part > 0] - 1
            before = before[smaller[before]]
            if len(before):
                _append(sa, before, text[before], tails, down=True)
    sa[0] = n - 1
    return sa


def _equal_neighbours(text: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """For sorted substrings, whether each equals the one before it."""
    same = np.r_[False, size[1:] == size[:-1]]
    rows = np.flatnonzero(same)
    k = 0
    while len(rows):
        equal = text[at[rows] + k] == text[at[rows - 1] + k]
        same[rows[~equal]] = False
        rows = rows[equal & (size[rows] > k + 1)]
        k += 1
    return same


def _order_names(names: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """Rank of each suffix of the string of names, by naming pairs until names differ or span ``depth``."""
    n, span = len(names), 1
    rank = names
    while rank.max() + 1 < n and span < n:
        reach = at[np.minimum(np.arange(n) + span, n - 1)] - at
        if (reach[: max(1, n - span)] >= depth).all():
            break
        following = np.zeros(n, np.int64)
        following[: n - span] = rank[span:].astype(np.int64) + 1
        pair = rank.astype(np.int64) * (n + 2) + following
        rank = np.unique(pair, return_inverse=True)[1]
        span *= 2
    return rank


def suffix_array(data: np.ndarray, depth: int = 1 << 62) -> np.ndarray:
    """Positions of all suffixes of ``data`` (uint8) in order; suffixes that agree in ``depth`` or more
    bytes may stand in any order."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int32)
    # Characters become 1, 2, ... in order: a small alphabet has few buckets and sorts as single bytes.
    used = np.bincount(data, minlength=256) > 0
    code = np.cumsum(used).astype(np.uint8 if used.sum() < 256 else np.int16)
    text = np.append(code[data], code.dtype.type(0))
    smaller = classify(text)
    leftmost = np.flatnonzero(smaller[1:] & ~smaller[:-1]).astype(np.int32) + 1
    bounds = np.concatenate([[0], np.cumsum(np.bincount(text))]).astype(np.int64)
    order = leftmost
    if len(leftmost) > 1:
        by_char = leftmost[np.argsort(text[leftmost], kind="stable")]
        sa = induce(text, smaller, by_char, bounds)
        is_leftmost = np.zeros(n + 1, bool)
        is_leftmost[leftmost] = True
        sorted_subs = sa[is_leftmost[sa]]
        number = np.zeros(n + 1, np.int32)
        number[leftmost] = np.arange(len(leftmost))
        ends = np.r_[leftmost[1:] + 1, n + 1]
        at = number[sorted_subs]
        size = ends[at] - sorted_subs
        names = np.zeros(len(leftmost), np.int64)
        names[at] = np.cumsum(~_equal_neighbours(text, sorted_subs, size)) - 1
        order = leftmost[np.argsort(_order_names(names, leftmost, depth), kind="stable")]
    return induce(text, smaller, order, bounds)[1:]


def common_prefixes(data: np.ndarray, here: np.ndarray, other: np.ndarray, room: np.ndarray) -> np.ndarray:
    """Permuted common prefixes: for positions ``here`` in text order, each with its neighbour
    ``other``, the length of their common prefix, at most ``room``.

    A pair that continues the pair one position before it is one shorter than that; only the other,
    irreducible pairs are compared, eight bytes at a time.
    """
    if not len(here):
        return np.zeros(0, np.int64)
    follows = np.r_[False, (here[1:] == here[:-1] + 1) & (other[1:] == other[:-1] + 1) & (data[here[:-1]] == data[other[:-1]])]
    padded = np.concatenate([data, np.zeros(16, np.uint8)])
    words = np.lib.stride_tricks.sliding_window_view(padded, 8)
    first = np.flatnonzero(~follows)
    a, b = here[first].astype(np.int64), other[first].astype(np.int64)
    # An irreducible pair may be extended to the end of its run of pairs.
    most = room[first].astype(np.int64)
    length = np.zeros(len(first), np.int64)
    live = np.arange(len(first))
    while len(live):
        x = np.ascontiguousarray(words[a[live] + length[live]]).view("<u8")[:, 0]
        y = np.ascontiguousarray(words[b[live] + length[live]]).view("<u8")[:, 0]
        differ = x ^ y
        low = differ & (~differ + np.uint64(1))
        step = np.where(differ == 0, 8, np.bitwise_count(low - np.uint64(1)) // 8)
        length[live] += step
        live = live[(step == 8) & (length[live] < most[live])]
    length = np.minimum(length, most)
    run = np.cumsum(~follows) - 1
    out = length[run] - (here - here[first][run])
    return np.minimum(np.maximum(out, 0), room)
