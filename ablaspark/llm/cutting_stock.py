"""One-dimensional cutting stock by column generation, over a histogram of lengths.

The linear program has a row per length class, not per item, so its size is fixed however many
items there are. Its duals price new patterns by an unbounded knapsack (dynamic program over
the capacity); the solution is rounded down and what is left is packed first-fit decreasing,
which touches at most (classes x items of a pattern) items.
"""

from __future__ import annotations

import numpy as np

#: Stop when no pattern is priced above 1 by more than this: the solution is then within that share of the optimum.
TOLERANCE = 1e-3


def knapsack(values: np.ndarray, sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Counts per item of a most valuable filling of ``capacity``, items without limit."""
    best, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    smallest = int(sizes.min())
    for room in range(smallest, capacity + 1):
        fit = sizes <= room
        gain = np.where(fit, values + best[np.where(fit, room - sizes, 0)], -1.0)
        k = int(gain.argmax())
        if gain[k] > best[room - 1] + 1e-12:
            best[room], choice[room] = gain[k], k
        else:
            best[room], choice[room] = best[room - 1], -1
    counts, room = np.zeros(len(sizes), dtype=np.int64), capacity
    while room >= smallest:
        if choice[room] < 0:
            room -= 1
        else:
            counts[choice[room]] += 1
            room -= int(sizes[choice[room]])
    return counts


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Matrix product in this thread: a threaded library would fight with Spark's tasks for the cores."""
    return np.einsum("ij,jk->ik", a, b)


def solve(sizes: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = 20_000) -> tuple[np.ndarray, np.ndarray]:
    """Basic solution (patterns as columns, how often each) of the relaxed cutting-stock program.

    Revised simplex: start with one pattern per class, enter the best-priced pattern until none improves.
    """
    per = capacity // sizes
    basis = np.diag(per.astype(float))
    inverse = np.diag(1.0 / per)
    level = inverse @ demand.astype(float)
    for step in range(rounds):
        duals = inverse.sum(axis=0)
        column = knapsack(np.maximum(duals, 0.0), sizes, capacity)
        if duals @ column <= 1 + TOLERANCE:
            return np.rint(basis).astype(np.int64), level
        change = inverse @ column
        ratios = np.where(change > 1e-10, level / np.where(change > 1e-10, change, 1.0), np.inf)
        out = int(ratios.argmin())
        basis[:, out] = column
        pivot = inverse[out] / change[out]
        inverse -= np.outer(change, pivot)
        inverse[out] = pivot
        level = np.maximum(level - ratios[out] * change, 0.0)
        level[out] = ratios[out]
        if step % 200 == 199:  # a Newton step, so that rounding errors don't add up
            error = np.eye(len(basis)) - _product(basis, inverse)
            inverse = inverse + _product(inverse, error)
            level = np.maximum(inverse @ demand, 0.0)
    raise RuntimeError("column generation did not end")


def first_fit_decreasing(sizes: np.ndarray, counts: np.ndarray, capacity: int) -> list[np.ndarray]:
    """Pack the items left over; patterns as counts per class."""
    bins, rooms = [], []
    for k in np.argsort(-sizes, kind="stable"):
        left = int(counts[k])
        for i in range(len(bins)):
            if not left:
                break
            n = min(left, rooms[i] // int(sizes[k]))
            if n:
                bins[i][k] += n
                rooms[i] -= n * int(sizes[k])
                left -= n
        while left:
            n = min(left, capacity // int(sizes[k]))
            pattern = np.zeros(len(sizes), dtype=np.int64)
            pattern[k] = n
            bins.append(pattern)
            rooms.append(capacity - n * int(sizes[k]))
            left -= n
    return bins


def plan(sizes: list[int], counts: list[int], capacity: int, quantum: int) -> list[tuple[np.ndarray, int]]:
    """Patterns (counts per size) and how often each is used; together they hold exactly ``counts``.

    Sizes that are whole quanta go through the linear program; smaller ones fill sequences of their own. What rounding
    leaves of both is packed together.
    """
    sizes, counts = np.asarray(sizes, dtype=np.int64), np.asarray(counts, dtype=np.int64)
    left, used = counts.copy(), []
    whole = np.flatnonzero(sizes % quantum == 0)
    if len(whole):
        columns, level = solve(sizes[whole] // quantum, counts[whole], capacity // quantum)
        for j in np.argsort(-level, kind="stable"):
            times = int(level[j] + 1e-6)
            pattern = np.zeros(len(sizes), dtype=np.int64)
            pattern[whole] = columns[:, j]
            if pattern.any():
                times = min(times, int((left[pattern > 0] // pattern[pattern > 0]).min()))
            if times and pattern.any():
                used.append((pattern, times))
                left -= times * pattern
    for k in np.flatnonzero(sizes % quantum):
        per = capacity // int(sizes[k])
        if times := int(left[k]) // per:
            pattern = np.zeros(len(sizes), dtype=np.int64)
            pattern[k] = per
            used.append((pattern, times))
            left[k] -= times * per
    return used + [(p, 1) for p in first_fit_decreasing(sizes, left, capacity)]
