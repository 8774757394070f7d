"""The vector operators against plain Python, on odd rows and with small tasks."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest

from ablaspark.llm import rtree, vector_codes, voronoi
from ablaspark.llm.vectors import Best

SCHEMA = "vec_id bigint, embedding array<float>, label int"
#: A table may have the names that the operators use inside.
CLASHES = ("row_no", "id", "vec", "cell", "dist", "task", "item", "tile", "kth", "low", "code", "error", "score", "rank", "same")


def number(x):
    return -1 << 62 if x is None else x


def usable(rows, scale):
    ok = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    longest = max((len(r[1]) for r in ok), default=0)
    return [(i, [math.floor(scale * x) for x in v] + [0] * (longest - len(v)), label) for i, v, label in ok]


def best(rows, k):
    """The first k of (score, id): higher scores, smaller ids, null ids last."""
    return sorted(rows, key=lambda r: (-r[0], r[1] is None, number(r[1])))[:k]


def inner(a, b):
    return sum(x * y for x, y in zip(a, b))


def brute_top(rows, k=5):
    rows, out = usable(rows, 256), Counter()
    for a, (i, v, _) in enumerate(rows):
        if i is not None and i % 50 == 0:
            found = best([(inner(v, w), j) for b, (j, w, _) in enumerate(rows) if a != b], k)
            out.update((i, rank, j, s) for rank, (s, j) in enumerate(found, 1))
    return out


def brute_negatives(rows):
    rows = [(i, v, (label + 1) % 10 if i is not None and i % 7 == 0 else label) for i, v, label in usable(
        [r for r in rows if r[2] is not None], 256)]
    out = Counter()
    for a, (i, v, label) in enumerate(rows):
        if i is None or i % 50:
            continue
        scored = [(inner(v, w), j, other) for b, (j, w, other) in enumerate(rows) if a != b]
        for s, j in best([(s, j) for s, j, other in scored if other == label], 5):
            window = [(t, n) for t, n, other in scored if other != label and 50 * s <= 100 * t <= 95 * s]
            out.update((i, j, rank, n, s, t) for rank, (t, n) in enumerate(best(window, 3), 1))
    return out


def brute_codes(rows):
    rows = usable(rows, 4096)
    width = max(1, -(-max((len(v) for _, v, _ in rows), default=0) // 8))
    parts = [[tuple((v + [0] * 8 * width)[p * width:(p + 1) * width]) for p in range(8)] for _, v, _ in rows]
    heads = sorted(range(len(rows)), key=lambda r: (rows[r][0] is None, number(rows[r][0]), rows[r][1]))[:16]
    books = [[parts[r][p] for r in heads] for p in range(8)]
    away = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    for final in [False] * 6 + [True]:
        chosen = [[min(range(len(heads)), key=lambda e: (away(x[p], books[p][e]), e)) for p in range(8)] for x in parts]
        for p in range(8 if not final else 0):
            for e in range(len(heads)):
                mine = [x[p] for x, c in zip(parts, chosen) if c[p] == e]
                if mine:
                    books[p][e] = tuple(sum(c) // len(mine) for c in zip(*mine))
    errors = [sum(away(x[p], books[p][c[p]]) for p in range(8)) for x, c in zip(parts, chosen)]
    labels = Counter()
    for (_, _, label), error in zip(rows, errors):
        labels[label] += error
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return Counter((i, "".join(f"{c:02x}" for c in code), error, labels[label], digest)
                   for (i, _, label), code, error in zip(rows, chosen, errors))


def vectors(n, dim=12, seed=3):
    """Clusters, a vector that a third of the rows share, ties, repeated ids and rows, nulls, ragged and non-finite vectors."""
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 0.4) for _ in range(dim)] for _ in range(5)]
    rows = []
    for i in range(n):
        centre = rng.choice(centres)
        v = centres[0] if i % 3 == 0 else [round(c + rng.gauss(0, 0.08), 2) for c in centre]
        rows.append((i, v, rng.choice([0, 1, 2, 2, None, -1])))
    nan, inf = float("nan"), float("inf")
    odd = [(50, [0.5] * dim, 1), (50, [0.5] * dim, 1), (50, [0.25] * dim, 2), (None, [0.5] * dim, 1), (None, [0.5] * dim, None), (100, None, 1),
           (None, None, None), (150, [nan] * dim, 1), (200, [inf] + [0.1] * (dim - 1), 2), (250, [None] * dim, 0), (300, [], 1), (350, [0.5, -0.5], 2),
           (-50, [-0.5] * dim, 1), (-7, [0.5] * dim, 9), (0, [0.0] * dim, 0)]
    rows += odd
    rng.shuffle(rows)
    # as the float column holds them
    return [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], label) for i, v, label in rows]


@pytest.fixture(scope="module")
def rows():
    return vectors(1200)


@pytest.fixture(scope="module")
def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).selectExpr("*", *[f"'x' as `{c}`" for c in CLASHES]).repartition(5)


def counted(df):
    return Counter(map(tuple, df.collect()))


def test_top_k(table, rows):
    assert counted(voronoi.top_k(table)) == brute_top(rows)


def test_top_k_in_small_groups_and_shards(table, rows, monkeypatch):
    monkeypatch.setattr(voronoi, "QUERIES", 4)
    monkeypatch.setattr(voronoi, "ROWS", 100)
    assert counted(voronoi.top_k(table)) == brute_top(rows)


def test_summaries_leave_rows_out(spark, monkeypatch):
    """Far clusters are not sent to a group that can't need them."""
    rng = random.Random(5)
    rows = [(i, [(50.0 if j == i % 4 else 0.0) + rng.gauss(0, 0.01) for j in range(8)], 0) for i in range(800)]
    df = spark.createDataFrame(rows, SCHEMA)
    monkeypatch.setattr(voronoi, "QUERIES", 5)
    sent = []
    deal = voronoi.by_task

    def count(rows, *args):
        sent.append(rows.count())
        return deal(rows, *args)

    monkeypatch.setattr(voronoi, "by_task", count)
    found = [r["vec_id"] % 4 == r["query_id"] % 4 for r in voronoi.top_k(df, every=25).collect()]
    assert len(found) == 32 * 5 and all(found)
    assert sent[0] < 4 * 800 + 32 * 4  # eight groups or more, each would get 800 rows


def test_hard_negatives(table, rows):
    assert counted(rtree.hard_negatives(table)) == brute_negatives(rows)


def test_hard_negatives_in_small_tiles_and_blocks(table, rows, monkeypatch):
    for name, size in (("TILE", 40), ("BLOCK", 50), ("ITEMS", 7)):
        monkeypatch.setattr(rtree, name, size)
    assert counted(rtree.hard_negatives(table)) == brute_negatives(rows)


def test_codes(table, rows):
    assert counted(vector_codes.codes(table)) == brute_codes(rows)


def test_few_and_no_rows(spark, rows):
    few = [r for r in rows if r[0] in (50, 0, 7)]
    df = spark.createDataFrame(few, SCHEMA)
    assert counted(voronoi.top_k(df)) == brute_top(few)
    assert counted(rtree.hard_negatives(df)) == brute_negatives(few)
    assert counted(vector_codes.codes(df)) == brute_codes(few)
    for none in (df.limit(0), df.filter("vec_id = 100")):
        assert voronoi.top_k(none).collect() == rtree.hard_negatives(none).collect() == vector_codes.codes(none).collect() == []
    one = spark.createDataFrame([(50, [1.0], 1)], SCHEMA)
    assert voronoi.top_k(one).collect() == rtree.hard_negatives(one).collect() == [] and vector_codes.codes(one).count() == 1
    empty = spark.createDataFrame([(50, [], 1), (51, [], 1), (52, [], None)], SCHEMA)
    assert [tuple(r) for r in voronoi.top_k(empty).collect()] == [(50, 1, 51, 0), (50, 2, 52, 0)]
    assert {r["code"] for r in vector_codes.codes(empty).collect()} == {"00" * 8}


def test_too_large_components_are_refused(spark):
    df = spark.createDataFrame([(50, [1e30], 1), (51, [1.0], 1)], SCHEMA)
    for operator in (voronoi.top_k, rtree.hard_negatives, vector_codes.codes):
        with pytest.raises(ValueError):
            operator(df)


def test_dominated_entries_are_never_nearest():
    rng = np.random.default_rng(1)
    entries, parts = rng.integers(-900, 900, (16, 3)), rng.integers(-1500, 1500, (5000, 3))
    grid = vector_codes.Grid(entries)
    away = ((parts[:, None] - entries) ** 2).sum(axis=2)
    index, error = grid.nearest(parts)
    assert (index == away.argmin(axis=1)).all() and (error == away.min(axis=1)).all()
    kept = [int(m).bit_count() for m in grid.bits]
    assert len(kept) < 2500 and np.mean(kept) < 8
    grid.weights[:] = 0  # every cell has the same hash
    grid._forget()
    assert (grid.nearest(parts)[0] == index).all()


def test_memory_starts_anew(table, rows, monkeypatch):
    monkeypatch.setattr(vector_codes, "MEMORY", 3)
    grid = vector_codes.Grid(np.arange(12).reshape(4, 3) * 40)
    parts = np.random.default_rng(2).integers(0, 500, (300, 3))
    for some in (parts[:100], parts[100:], parts[:50]):
        assert (grid.nearest(some)[0] == ((some[:, None] - grid.entries) ** 2).sum(axis=2).argmin(axis=1)).all()


def test_best_keeps_ties_by_id():
    kept = Best(2, 2)
    kept.offer(np.array([0, 1]), np.array([[5.0, 5.0, 5.0], [1.0, -np.inf, 2.0]]), np.array([9, 3, 4]), np.zeros(3, bool), np.arange(3))
    kept.offer(np.array([0]), np.array([[5.0, 5.0]]), np.array([1, 0]), np.array([False, True]), np.array([7, 8]))
    assert kept.id[0].tolist() == [1, 3] and kept.id[1].tolist() == [4, 9]
