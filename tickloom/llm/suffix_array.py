"""Linear-time suffix sorting by grouping, without recursion and without renaming.

Phase one gathers suffixes into groups by their longest Lyndon prefix. Groups
are taken in descending order; each member points to the previous suffix that
is in a smaller group, and suffixes that are pointed to move behind the rest of
their group, the further the more members point to them. Phase two walks the
suffixes in ascending order and puts the one before each, and those along its
chain of pointers, at the next free place of their groups.
"""

from __future__ import annotations

import numpy as np


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Starts of the suffixes of a sequence of integers in ascending order; a proper prefix comes first."""
    n = len(symbols) + 1
    if n == 1:
        return np.empty(0, np.int64)
    text = np.empty(n, np.int64)
    text[:-1] = symbols
    text[-1] = symbols.min() - 1
    start_order = np.argsort(text, kind="stable")
    _, first, size = np.unique(text[start_order], return_index=True, return_counts=True)
    order: list[int] = start_order.tolist()
    place_of = np.empty(n, np.int64)
    place_of[start_order] = np.arange(n)
    place: list[int] = place_of.tolist()
    group_of = np.empty(n, np.int64)
    group_of[start_order] = np.repeat(first, size)
    group: list[int] = group_of.tolist()  # of a suffix: where its group starts in the order
    sizes = [0] * n
    for g, s in zip(first.tolist(), size.tolist(), strict=True):
        sizes[g] = s
    previous = [-1] * n

    end = n
    while end:
        begin = group[order[end - 1]]
        members = order[begin:end]
        end = begin
        if len(members) > 1:
            members.sort()
        hits: dict[int, int] = {}
        for i in members:
            p = i - 1
            while p >= 0 and group[p] >= begin:
                p = previous[p]
            previous[i] = p
            if p >= 0:
                hits[p] = hits.get(p, 0) + 1
        if not hits:
            continue
        by_count: dict[int, list[int]] = {}
        for p, c in hits.items():
            by_count.setdefault(c, []).append(p)
        for c in sorted(by_count, reverse=True):
            pointed = by_count[c]
            for p in pointed:
                g = group[p]
                sizes[g] -= 1
                last = g + sizes[g]
                at, other = place[p], order[last]
                order[at], order[last] = other, p
                place[other], place[p] = at, last
            starts = [group[p] + sizes[group[p]] for p in pointed]
            for p, new in zip(pointed, starts, strict=True):
                group[p] = new
                sizes[new] += 1

    out, free = [-1] * n, list(range(n))
    placed = bytearray(n)
    out[0] = n - 1
    placed[n - 1] = 1
    for i in range(n):
        j = out[i] - 1
        while j >= 0 and not placed[j]:
            g = group[j]
            at = free[g]
            free[g] = at + 1
            out[at] = j
            placed[j] = 1
            j = previous[j]
    return np.array(out[1:], np.int64)
