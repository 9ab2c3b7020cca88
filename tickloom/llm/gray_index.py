"""Hierarchical index of bit codes in Gray order, for search by Hamming distance.

Codes sorted by Gray rank have few changes between neighbours. Groups of
``FAN`` neighbours form a node that holds the bits on which they all agree,
nodes form nodes in turn; bits that an upper node holds are factored out below.
A search walks down with the differences so far and leaves out whole groups
once they exceed the radius. A search for components also leaves out nodes all
of whose codes are already connected with the query, so a cluster of n codes
costs little more than n steps, not its pairs.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

FAN = 8
CHUNK = 2048
SEEDS = 64
MOST = 1 << 18
U = np.uint64


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """The place of each code in the reflected Gray sequence."""
    out = codes.copy()
    for s in (1, 2, 4, 8, 16, 32):
        out ^= out >> U(s)
    return out


class GrayIndex:
    def __init__(self, codes: np.ndarray, group: np.ndarray | None = None) -> None:
        """``codes``: 64-bit codes in any order, distinct within each ``group``; groups only matter to ``linked``."""
        group = np.zeros(len(codes), np.int64) if group is None else group
        self.order = np.lexsort((gray_rank(codes), group))
        self.codes, self.group = codes[self.order], group[self.order]
        ones, zeros = [self.codes], [self.codes]  # bits set in all and in any code of a node
        while len(ones[-1]) > FAN:
            cut = np.arange(0, len(ones[-1]), FAN)
            ones.append(np.bitwise_and.reduceat(ones[-1], cut))
            zeros.append(np.bitwise_or.reduceat(zeros[-1], cut))
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []  # from the top: (mask of the bits first held here, pattern)
        above = np.zeros(len(ones[-1]), U)
        for all_, any_ in zip(ones[::-1], zeros[::-1], strict=True):
            if len(above) != len(all_):
                above = np.repeat(above, FAN)[: len(all_)]
            shared = ~(all_ ^ any_)
            self.levels.append((shared & ~above, all_ & shared & ~above))
            above = shared

    def within(self, queries: np.ndarray, radius: int, chunk: int = 2048) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (place of a query, place of a code) at ``radius`` or less, by chunks of queries."""
        for at in range(0, len(queries), chunk):
            some = queries[at : at + chunk]
            top = len(self.levels[0][0])
            q, node = np.repeat(np.arange(len(some)), top), np.tile(np.arange(top), len(some))
            apart = np.zeros(len(q), np.int64)
            for depth, (mask, pattern) in enumerate(self.levels):
                if depth:
                    q, apart = np.repeat(q, FAN), np.repeat(apart, FAN)
                    node = np.repeat(node * FAN, FAN) + np.tile(np.arange(FAN), len(node))
                    real = node < len(mask)
                    q, apart, node = q[real], apart[real], node[real]
                apart = apart + np.bitwise_count((some[q] ^ pattern[node]) & mask[node])
                near = apart <= radius
                q, apart, node = q[near], apart[near], node[near]
            yield q + at, self.order[node]

    def ranges(self, values: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """(least, greatest) of the values, given in index order, in each node, from the top level."""
        out = [(values, values)]
        while len(out) < len(self.levels):
            cut = np.arange(0, len(out[-1][0]), FAN)
            out.append((np.minimum.reduceat(out[-1][0], cut), np.maximum.reduceat(out[-1][1], cut)))
        return out[::-1]

    def unlike(self, queries: np.ndarray, back: bool, radius: int, label: np.ndarray, groups: list[tuple[np.ndarray, np.ndarray]], most: int) -> tuple[np.ndarray, np.ndarray, int] | None:
        """(query, code, steps held at once): pairs of places in index order, of one group and unlike labels, at ``radius`` or less; with ``back`` only codes before the query. None if more than ``most`` steps would be held."""
        labels = self.ranges(label)
        top = len(self.levels[0][0])
        q, node = np.repeat(queries, top), np.tile(np.arange(top), len(queries))
        apart, held = np.zeros(len(q), np.int64), len(q)
        for depth, (mask, pattern) in enumerate(self.levels):
            if depth:
                held = max(held, len(q) * FAN)
                if held > most and len(queries) > 1:
                    return None
                q, apart = np.repeat(q, FAN), np.repeat(apart, FAN)
                node = (node[:, None] * FAN + np.arange(FAN)).ravel()
            end = q if back else len(self.codes)
            some = np.flatnonzero(node * FAN ** (len(self.levels) - 1 - depth) < end)
            q, node, apart = q[some], node[some], apart[some]
            (least, greatest), (low, high) = groups[depth], labels[depth]
            own, mine = self.group[q], label[q]
            some = np.flatnonzero((least[node] <= own) & (own <= greatest[node]) & ((low[node] != mine) | (high[node] != mine)))
            q, node, apart = q[some], node[some], apart[some]
            apart += np.bitwise_count((self.codes[q] ^ pattern[node]) & mask[node])
            some = np.flatnonzero(apart <= radius)
            q, node, apart = q[some], node[some], apart[some]
        return q, node, held

    def linked(self, radius: int, chunk: int = CHUNK, most: int = MOST) -> np.ndarray:
        """For each code the place of one code, the same for all that pairs at ``radius`` or less within a group connect.

        Neighbours in the index and a few codes dealt over it come first: they connect most of a cluster, so that the search over all codes finds little left of it.
        """
        n = len(self.codes)
        label, groups = np.arange(n), self.ranges(self.group)
        for d in range(1, FAN + 1):
            a = np.flatnonzero((self.group[d:] == self.group[:-d]) & (np.bitwise_count(self.codes[d:] ^ self.codes[:-d]) <= radius))
            label = joined_labels(n, [(a, a + d)], label)
        for queries, back in ((np.arange(0, n, -(-n // SEEDS)), False), (np.arange(n), True)):
            at, size = 0, chunk
            while at < len(queries):
                found = self.unlike(queries[at : at + size], back, radius, label, groups, most)
                if found is None:
                    size = max(1, size // 2)
                    continue
                a, b, held = found
                label = joined_labels(n, [(a, b)], label)
                at += size
                if 4 * held < most:
                    size = min(2 * size, chunk)
        out = np.empty(n, np.int64)
        out[self.order] = self.order[label]
        return out


def joined_labels(n: int, pairs: Iterable[tuple[np.ndarray, np.ndarray]], label: np.ndarray | None = None) -> np.ndarray:
    """Smallest place reachable over the pairs, for each of n places; ``label``: that over pairs before."""
    label = np.arange(n) if label is None else label
    for a, b in pairs:
        while True:
            low = np.minimum(label[a], label[b])
            if (label[a] == low).all() and (label[b] == low).all():
                break
            # Hook both ends' roots to the smaller one, then follow the pointers to their ends.
            np.minimum.at(label, label[a], low)
            np.minimum.at(label, label[b], low)
            while (label[label] != label).any():
                label = label[label]
    return label
