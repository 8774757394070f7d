"""Pairs of node ranges of a binary trie, traversed together under a Hamming budget.

A trie over sorted distinct 64-bit keys needs no nodes: a node is a range of keys that share a
prefix. Node pairs descend bit by bit; a pair whose prefixes differ in more bits than the budget
is pruned. Links are merged as they are found, so a dense group costs memory for its keys only.
"""

from __future__ import annotations

import numpy as np

BITS = 64
#: Node pairs with at most this many key pairs are compared key by key.
LEAF_PAIRS = 48
#: Node pairs or key pairs handled at once.
CHUNK = 1 << 20


class Forest:
    """Disjoint sets over key positions; the smallest position is the root."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def find(self, i: np.ndarray) -> np.ndarray:
        p = self.parent[i]
        while (up := self.parent[p]) is not None and (up != p).any():
            p = up
        return p

    def union(self, i: np.ndarray, j: np.ndarray) -> None:
        while len(i):
            i, j = self.find(i), self.find(j)
            apart = i != j
            i, j = np.minimum(i[apart], j[apart]), np.maximum(i[apart], j[apart])
            self.parent[j] = i  # of several only one is kept; the loop goes on until all are joined

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        every = np.arange(len(self.parent))
        root = self.find(every)
        return every[root != every], root[root != every]


def _compare(keys: np.ndarray, pairs: tuple[np.ndarray, ...], budget: int, forest: Forest) -> None:
    lo1, hi1, lo2, hi2, _ = pairs
    n2 = hi2 - lo2
    total = (hi1 - lo1) * n2
    ends = np.cumsum(total)
    cut = 0
    while cut < len(total):
        done = int(ends[cut - 1]) if cut else 0
        stop = max(cut + 1, int(np.searchsorted(ends, done + CHUNK, side="right")))
        size = total[cut:stop]
        own = np.repeat(np.arange(cut, stop), size)
        k = np.arange(len(own)) - np.repeat(np.cumsum(size) - size, size)
        i, j = lo1[own] + k // n2[own], lo2[own] + k % n2[own]
        near = (i < j) & (np.bitwise_count(keys[i] ^ keys[j]) <= budget)
        forest.union(i[near], j[near])
        cut = stop


def link(keys: np.ndarray, start: list[tuple[int, int, int, int, int]], depth: int, budget: int, half_budget: int
         ) -> tuple[np.ndarray, np.ndarray]:
    """Edges (positions) of a forest over all key pairs below the start pairs (lo, hi, lo, hi, bits that differ).

    Keys are sorted uint64. At most ``half_budget`` of the first 32 bits and ``budget`` of all bits differ.
    """
    forest = Forest(len(keys))
    stack = [(depth, tuple(np.array(c, dtype=np.int64) for c in zip(*start)))] if start else []
    while stack:
        depth, pairs = stack.pop()
        lo1, hi1, lo2, hi2, diff = pairs
        leaf = ((hi1 - lo1) * (hi2 - lo2) <= LEAF_PAIRS) | (depth == BITS)
        if leaf.any():
            _compare(keys, tuple(c[leaf] for c in pairs), budget, forest)
        lo1, hi1, lo2, hi2, diff = (c[~leaf] for c in pairs)
        if not len(lo1):
            continue
        bit = np.uint64(1 << (BITS - 1 - depth))
        below = np.uint64(2 * int(bit) - 1)
        mid1 = np.searchsorted(keys, (keys[lo1] & ~below) | bit)
        mid2 = np.searchsorted(keys, (keys[lo2] & ~below) | bit)
        same = lo1 == lo2
        limit = half_budget if depth < BITS // 2 else budget
        children = [(lo1, mid1, lo2, mid2, diff), (mid1, hi1, mid2, hi2, diff), (lo1, mid1, mid2, hi2, diff + 1),
                    tuple(c[~same] for c in (mid1, hi1, lo2, mid2, diff + 1))]
        both = tuple(np.concatenate(c) for c in zip(*children))
        kept = (both[0] < both[1]) & (both[2] < both[3]) & (both[4] <= limit)
        both = tuple(c[kept] for c in both)
        for a in range(0, len(both[0]), CHUNK):
            stack.append((depth + 1, tuple(c[a:a + CHUNK] for c in both)))
    return forest.edges()


def masks(bits: int, budget: int) -> np.ndarray:
    """All numbers of ``bits`` bits with at most ``budget`` of them set."""
    out, ring = [0], [0]
    for _ in range(budget):
        ring = sorted({m | 1 << b for m in ring for b in range(bits) if not m >> b & 1})
        out += ring
    return np.array(out, dtype=np.uint64)
