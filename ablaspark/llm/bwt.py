"""Burrows-Wheeler transforms of string collections, and their merge by interleave refinement.

A shard's transform comes from sorting its own strings' suffixes once. Shards are merged without
touching suffixes again: start with any interleave of the shards' rows and sort it stably by the
symbols of the transforms, over and over. After h rounds the rows are in the order of their first h symbols, and
the round in which two neighbours come apart is the length of their common prefix.
Strings end with the symbol 0 and are read in a circle, so rows past an end stay well defined.
"""

from __future__ import annotations

import numpy as np

#: Common prefixes that reach the depth of the merge.
DEEP = 255


def stable_order(key: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Stable order of numbers of ``width`` bits, and the numbers in it. Where number and place fit one word, words are sorted."""
    place = max(1, (len(key) - 1).bit_length())
    if width + place > 64:
        order = np.argsort(key, kind="stable")
        return order, key[order]
    words = (key << np.uint64(place)) | np.arange(len(key), dtype=np.uint64)
    words.sort()
    return (words & np.uint64((1 << place) - 1)).astype(np.int64), words >> np.uint64(place)


def circular_ranks(symbols: np.ndarray, begin: np.ndarray, size: np.ndarray, depth: int | None = None) -> np.ndarray:
    """Order of all rotations of the strings, which lie one after another in ``symbols``, by doubling.

    Rotations that share their first ``depth`` symbols may stay in the order of their places.
    """
    n = len(symbols)
    own = np.repeat(np.arange(len(size)), size)
    base, length = begin[own], size[own]
    place = np.arange(n) - base

    def ahead(k: int) -> np.ndarray:
        return base + (place + k) % length

    # symbols that occur, by number, need fewer bits
    found = np.bincount(symbols, minlength=256) > 0
    dense = (np.cumsum(found) - 1).astype(np.uint64)[symbols]
    bits, index = max(1, (int(found.sum()) - 1).bit_length()), max(1, (n - 1).bit_length())
    reach = max(1, min(8, (64 - index) // bits))
    step = ahead(1)
    key, at = np.zeros(n, np.uint64), np.arange(n)
    for _ in range(reach):
        key = (key << np.uint64(bits)) | dense[at]
        at = step[at]
    width, longest = bits * reach, int(size.max())
    far = longest if depth is None else min(longest, depth)
    while True:
        order, sorted_key = stable_order(key, width)
        new = np.cumsum(np.concatenate(([0], sorted_key[1:] != sorted_key[:-1])))
        if reach >= far or new[-1] == n - 1:
            return order
        rank = np.empty(n, np.uint64)
        rank[order] = new
        key, width = (rank << np.uint64(index)) | rank[ahead(reach)], 2 * index
        reach *= 2


def transform(symbols: np.ndarray, begin: np.ndarray, size: np.ndarray, depth: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Rows (positions in sorted order) and the symbol before each row.

    Without a ``depth`` rows are sorted to their ends. A merge to some depth needs no more than that many symbols: rows that
    share them all may change places, which moves no other row.
    """
    rows = circular_ranks(symbols, begin, size, depth)
    before = np.arange(len(symbols)) - 1
    before[begin] = begin + size - 1
    return rows, symbols[before[rows]]


def pairs(symbols: np.ndarray) -> np.ndarray:
    """The two symbols before each row of a transform, as one number, so that a round can take two steps."""
    previous = np.empty(len(symbols), np.int64)
    previous[np.argsort(symbols, kind="stable")] = np.arange(len(symbols))
    return (symbols[previous].astype(np.uint16) << np.uint16(8)) | symbols


def merge(transforms: list[np.ndarray], depth: int, step: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Interleave (shard of each merged row) and common prefix of each row with the one before (DEEP from depth on).

    With ``step`` 2 the transforms are those of ``pairs``, and common prefixes are rounded down to even numbers. The rows of a
    single transform are sorted already, so the order of its symbols is the same in every round.
    """
    kind = np.uint8 if len(transforms) <= 256 else np.uint16
    shard = np.repeat(np.arange(len(transforms), dtype=kind), [len(t) for t in transforms])
    joined = np.concatenate(transforms)
    n = len(joined)
    common = np.full(n, DEEP, np.uint8)
    common[:1] = 0
    block = np.zeros(n, np.int32)
    symbol = np.empty(n, joined.dtype)
    apart = np.ones(n, bool)
    for h in range(0, depth, step):
        if h == 0 or len(transforms) > 1:
            symbol[np.argsort(shard, kind="stable")] = joined  # each shard's rows keep their order
            order = np.argsort(symbol, kind="stable")
            shard, sorted_ = shard[order], symbol[order]
            differ = sorted_[1:] != sorted_[:-1]
        block = block[order]
        apart[1:] = differ | (block[1:] != block[:-1])
        common[apart & (common == DEEP)] = h
        np.cumsum(apart, out=block)
    return shard, common


def repeated_intervals(common: np.ndarray, depth: int) -> np.ndarray:
    """Number of the interval of rows that share ``depth`` symbols, for each row."""
    return np.cumsum(common < depth)
