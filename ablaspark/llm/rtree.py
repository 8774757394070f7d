"""Inner-product search with windows in an STR-packed R-tree.

The upper part of the tree is dealt out by Spark: sort-tile-recursive cuts of a few coordinates divide the rows into tiles,
each with its minimum bounding box, and a tile into blocks of bounded size. The lower part is built by the task that has a
block: its rows are packed sort-tile-recursively into leaves, leaves into nodes. Over a box, each coordinate gives an interval
of products, and their sum an interval [least, most] of inner products. A box is pruned if most is below the item's window
or strictly below its k-th best score, or if least is above the window.

The search is best-first on both levels. An item (a vector with a window of scores) first visits only the tile with the
highest bound, then, with the k-th score found there, those other tiles that may still improve it. Inside a block the queue
holds (bound, box, items that still need it), so one step scores a leaf for all its items.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import power_of_two, stored
from .vectors import Best, Shape, by_task, cuts_of, floored, ids_of, lists, matrix, runs, shape_of, slices, usable

#: Rows that the cuts of the tiles are taken from (picked by the hash of the vector); every row is placed in a tile.
SAMPLE = 1 << 14
#: Rows a tile should have, and the greatest number of tiles; the table of their boxes is bounded by it.
TILE, TILES = 1 << 13, 1 << 12
#: Rows of a block and items of a task (about: both are dealt by number).
BLOCK, ITEMS = 1 << 14, 1 << 16
SLABS, LEAF, FANOUT = 4, 128, 16
#: Items that go through a tree together.
_TOGETHER = 512


class Tiles(NamedTuple):
    """Coordinates and cut points of the slabs, level by level; boxes and blocks of the tiles."""

    coordinates: list[int]
    cuts: list[np.ndarray]
    low: np.ndarray
    high: np.ndarray
    blocks: np.ndarray
    shape: Shape

    def of(self, x: np.ndarray) -> np.ndarray:
        tile = np.zeros(len(x), np.int64)
        for coordinate, cuts in zip(self.coordinates, self.cuts):
            tile = tile * SLABS + (x[:, [coordinate]] > cuts[tile]).sum(axis=1)
        return tile


def interval(items: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(least, most) inner product of each item with a point of each box: per coordinate the lower and the higher product."""
    up, down = np.maximum(items, 0), np.minimum(items, 0)
    return up @ low.T + down @ high.T, up @ high.T + down @ low.T


class Tree:
    """The R-tree of a block."""

    def __init__(self, x: np.ndarray):
        order = _str_order(x, LEAF)
        self.order, self.x, self.levels = order, x[order], []
        starts = np.arange(0, len(x), LEAF)
        low, high = np.minimum.reduceat(self.x, starts), np.maximum.reduceat(self.x, starts)
        self.levels.append((low, high))
        while len(low) > FANOUT:
            starts = np.arange(0, len(low), FANOUT)
            low, high = np.minimum.reduceat(low, starts), np.maximum.reduceat(high, starts)
            self.levels.append((low, high))

    def search(self, items: np.ndarray, low: np.ndarray, high: np.ndarray, best: Best, score) -> None:
        """Best-first; ``score(items, rows)`` offers the rows of a leaf to the items that still need it."""
        queue, made = [], 0

        def push(level: int, boxes: slice, mine: np.ndarray) -> None:
            nonlocal made
            least, most = interval(items[mine], *(side[boxes] for side in self.levels[level]))
            may = (most >= np.maximum(low[mine], best.kth()[mine])[:, None]) & (least <= high[mine][:, None])
            for box in np.flatnonzero(may.any(axis=0)):
                some = may[:, box]
                made += 1
                heapq.heappush(queue, (-float(most[some, box].max()), made, level, boxes.start + int(box), mine[some], most[some, box]))

        push(len(self.levels) - 1, slice(0, len(self.levels[-1][0])), np.arange(len(items)))
        while queue:
            _, _, level, box, mine, most = heapq.heappop(queue)
            mine = mine[most >= np.maximum(low[mine], best.kth()[mine])]
            if not len(mine):
                continue
            if level:
                push(level - 1, slice(box * FANOUT, min((box + 1) * FANOUT, len(self.levels[level - 1][0]))), mine)
            else:
                rows = slice(box * LEAF, min((box + 1) * LEAF, len(self.x)))
                score(mine, rows)


def _str_order(x: np.ndarray, leaf: int) -> np.ndarray:
    """Sort-tile-recursive: slabs by one coordinate after another, those with the greatest spread first."""
    pages = -(-len(x) // leaf)
    levels = min(x.shape[1], max(1, int(np.ceil(np.log2(max(pages, 1)) / np.log2(SLABS)))))
    slab, order = np.zeros(len(x), np.int64), np.arange(len(x))
    for coordinate in np.argsort(-x.var(axis=0), kind="stable")[:levels]:
        order = np.lexsort((x[:, coordinate], slab))
        sizes = np.bincount(slab)
        inside = np.arange(len(x)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        placed = slab[order] * SLABS + inside * SLABS // np.repeat(sizes, sizes)
        slab = np.empty(len(x), np.int64)
        slab[order] = np.unique(placed, return_inverse=True)[1]
    return order


def _cuts(rows: DataFrame, shape: Shape) -> tuple[list[int], list[np.ndarray]]:
    count = power_of_two(shape.rows / TILE, 1, TILES)
    share = min(1.0, SAMPLE / max(shape.rows, 1))
    sample = rows.filter(F.pmod(F.xxhash64("row_no"), F.lit(1 << 30)) < int(share * (1 << 30))).select("vec").limit(2 * SAMPLE)
    x = matrix(pa.array([r["vec"] for r in sample.collect()], pa.list_(pa.int64())), shape.dim)
    levels = -(-(count.bit_length() - 1) // 2) if len(x) and shape.dim else 0
    coordinates = np.argsort(-x.var(axis=0), kind="stable")[:levels].tolist() if levels else []
    cuts, slab = [], np.zeros(len(x), np.int64)
    for level, coordinate in enumerate(coordinates):
        every = cuts_of(x[:, coordinate], SLABS)  # for slabs without a sampled row
        table = np.array([cuts_of(x[slab == s, coordinate], SLABS) if (slab == s).any() else every for s in range(SLABS ** level)])
        cuts.append(table)
        slab = slab * SLABS + (x[:, [coordinate]] > table[slab]).sum(axis=1)
    return coordinates, cuts


def _placed(tiles: Tiles):
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tile = tiles.of(matrix(batch.column("vec"), tiles.shape.dim))
            yield batch.append_column("tile", pa.array(tile.astype(np.int32)))

    return place


class Index(NamedTuple):
    """The rows (row_no, id, label, vec, tile) and the tiles."""

    rows: DataFrame
    tiles: Tiles


def index(rows: DataFrame) -> Index:
    """Place every row (row_no, id, label, vec; stored) in a tile."""
    shape = shape_of(rows).checked()
    coordinates, cuts = _cuts(rows, shape)
    tiles = Tiles(coordinates, cuts, np.empty(0), np.empty(0), np.empty(0), shape)
    placed = stored(rows.select("row_no", "id", "label", "vec").mapInArrow(
        _placed(tiles), "row_no bigint, id bigint, label bigint, vec array<bigint>, tile int"), "rtree")
    count = SLABS ** len(coordinates)
    low, high, sizes = np.full((count, shape.dim), np.inf), np.full((count, shape.dim), -np.inf), np.zeros(count, np.int64)
    sides = placed.select("tile", F.posexplode("vec").alias("pos", "x")).groupBy("tile", "pos").agg(
        F.min("x").alias("low"), F.max("x").alias("high"), F.count(F.lit(1)).alias("n"))
    for r in placed.groupBy("tile").count().collect():
        sizes[r["tile"]] = r["count"]
    for r in sides.collect():  # at most TILES x components rows
        # a row that is too short counts as 0 there
        short = [0] if r["n"] < sizes[r["tile"]] else []
        low[r["tile"], r["pos"]], high[r["tile"], r["pos"]] = min(r["low"], *short, r["low"]), max(r["high"], *short, r["high"])
    seen = sizes[:, None] > 0
    low, high = (np.where(np.isfinite(side) | ~seen, side, 0.0) for side in (low, high))
    return Index(placed, tiles._replace(low=low, high=high, blocks=-(-sizes // BLOCK)))


def _dealt(tiles: Tiles, parts: int):
    """Each row with the tasks of its block, one for each part of the items."""
    base = np.concatenate(([0], np.cumsum(tiles.blocks)))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tile, row_no = batch.column("tile").to_numpy(), batch.column("row_no").to_numpy()
            task = (base[tile] + row_no % tiles.blocks[tile])[:, None] * parts + np.arange(parts)
            yield batch.append_column("tasks", lists(np.repeat(np.arange(len(tile)), parts), task.ravel(), len(tile)))

    return deal


def _routed(tiles: Tiles, parts: int, first: bool):
    """Each item with the tasks to visit, and the tile that it visits first."""
    used = np.flatnonzero(tiles.blocks)
    base = np.concatenate(([0], np.cumsum(tiles.blocks)))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch.num_rows, _TOGETHER):
                some = batch.slice(part.start, part.stop - part.start)
                low, high, kth = (some.column(c).to_numpy() for c in ("low", "high", "kth"))
                least, most = interval(matrix(some.column("vec"), tiles.shape.dim), tiles.low[used], tiles.high[used])
                may = (most >= np.maximum(low, kth)[:, None]) & (least <= high[:, None])
                top = np.where(may, most, -np.inf).argmax(axis=1)
                home = np.zeros_like(may)
                home[np.arange(len(may)), top] = True
                may &= home if first else ~home
                at, to = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
                item, which = np.nonzero(may)
                share = some.column("item").to_numpy()[item] % parts
                for block in range(int(tiles.blocks.max(initial=0))):
                    there = tiles.blocks[used[which]] > block
                    at.append(item[there])
                    to.append((base[used[which[there]]] + block) * parts + share[there])
                yield some.append_column("tasks", lists(np.concatenate(at), np.concatenate(to), some.num_rows))

    return route


def _searched(dim: int, k: int):
    """Build the tree of a task's block, then lead its items through it, some at a time."""
    class Task:
        def __init__(self):
            self.held, self.tree = [], None

        def row(self, batch: pa.RecordBatch) -> None:
            self.held.append(batch)

        def items(self, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            if not self.held:
                return
            if self.tree is None:
                block = pa.Table.from_batches(self.held).combine_chunks()
                one = lambda c: block.column(c).combine_chunks()
                self.tree = Tree(matrix(one("vec"), dim))
                order = self.tree.order
                self.ids, self.null = (x[order] for x in ids_of(one("id")))
                self.label, self.row_no = (one(c).to_numpy()[order] for c in ("label", "row_no"))
            items, low, high, label = matrix(batch.column("vec"), dim), *(batch.column(c).to_numpy() for c in ("low", "high", "label"))
            row_no, same = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("row_no", "same"))
            floor, best = np.maximum(low, batch.column("kth").to_numpy()), Best(batch.num_rows, k)

            def score(mine: np.ndarray, rows: slice) -> None:
                scores = items[mine] @ self.tree.x[rows].T
                out = (scores < floor[mine][:, None]) | (scores > high[mine][:, None])
                out |= (self.label[rows] == label[mine][:, None]) != same[mine][:, None]
                out |= self.row_no[rows] == row_no[mine][:, None]
                scores[out] = -np.inf
                best.offer(mine, scores, self.ids[rows], self.null[rows], self.row_no[rows])

            self.tree.search(items, floor, high, best, score)
            yield best.found({"item": batch.column("item").to_numpy()})

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, task = None, Task()
        for number, run in runs(batches, "task"):
            if number != now:
                now, task = number, Task()
            rows = run.column("item").null_count
            if rows:
                task.row(run.slice(0, rows))
            for some in slices(run.num_rows - rows, _TOGETHER):
                yield from task.items(run.slice(rows + some.start, some.stop - some.start))

    return search


_ITEM = "item bigint, row_no bigint, label bigint, vec array<bigint>, low double, high double, same boolean, kth double"


def search(tree: Index, items: DataFrame, k: int) -> DataFrame:
    """item, id, row_no, score, rank: the k best rows of each item in its window. ``items`` is stored.

    An item has a number, its own row_no (never found), label, vec, the window low to high, and ``same``: whether rows of its own
    label count, or those of the others. Higher scores come first, ties by smaller id (null last), then row number.
    """
    parts = max(1, -(-items.count() // ITEMS))
    tasks = int(tree.tiles.blocks.sum()) * parts
    data = tree.rows.mapInArrow(
        _dealt(tree.tiles, parts), "row_no bigint, id bigint, label bigint, vec array<bigint>, tile int, tasks array<bigint>").select(
        F.explode("tasks").alias("task"), F.lit(None).cast("bigint").alias("item"), "row_no", "id", "label", "vec",
        *[F.lit(None).cast(kind).alias(name) for name, kind in (("low", "double"), ("high", "double"), ("same", "boolean"), ("kth", "double"))])
    rank = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("id"), "row_no")

    def best(found: DataFrame) -> DataFrame:
        return found.withColumn("rank", F.row_number().over(rank)).filter(F.col("rank") <= k)

    def visit(asked: DataFrame, first: bool) -> DataFrame:
        routed = asked.mapInArrow(_routed(tree.tiles, parts, first), _ITEM + ", tasks array<bigint>").select(
            F.explode("tasks").alias("task"), "item", "row_no", F.lit(None).cast("bigint").alias("id"), "label", "vec",
            "low", "high", "same", "kth")
        both = by_task(data.unionByName(routed), tasks, "task", ["item"])  # rows come first, their item is null
        return best(both.mapInArrow(_searched(tree.tiles.shape.dim, k), "item bigint, id bigint, row_no bigint, score bigint"))

    asked = items.select("item", "row_no", "label", "vec", "low", "high", "same", F.lit(float("-inf")).alias("kth"))
    near = stored(visit(asked, True), "rtree-near")
    full = near.filter(F.col("rank") == k).select("item", F.col("score").cast("double").alias("seen"))
    # the first tile of an item is found again: it has the highest bound, which no score inside exceeds
    again = stored(asked.join(full, "item", "left").withColumn("kth", F.coalesce("seen", "kth")).drop("seen"), "rtree-items")
    return best(near.drop("rank").unionByName(visit(again, False).drop("rank")))


_MOST = float(1 << 54)


def hard_negatives(df: DataFrame, positives: int = 5, negatives: int = 3, every: int = 50, window: tuple[int, int] = (50, 95),
                   noise: tuple[int, int] = (7, 10), scale: int = 256, vec_id: str = "vec_id", vector: str = "embedding",
                   label: str = "label") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: hard negatives of each anchor and positive.

    Anchors are the rows whose id is divisible by ``every``. Their positives are the first other rows of the same label, and the
    negatives of a positive the first rows of other labels whose score lies between window[0] and window[1] per cent of the
    positive's. Higher scores come first, ties by smaller id (null last). Where the id is divisible by noise[0], the label counts as
    (label + 1) % noise[1]. Components are floor(scale * x). Rows with a null label, without a vector, or with a null or non-finite
    component take no part. Rows that share an id are different rows; a null id is no anchor. A positive without a negative gives
    no rows, nor does a negative positive score. Shorter vectors count as ending in zeros. Other columns are ignored, an empty table
    gives no rows. Vectors whose inner products could exceed 53 bits are refused.
    """
    number = F.col(vec_id).cast("bigint")
    name = F.col(label).cast("bigint")
    shifted = F.when(F.coalesce(number % noise[0] == 0, F.lit(False)), (name + 1) % noise[1]).otherwise(name)
    rows = stored(df.filter(usable(vector) & F.col(label).isNotNull()).select(
        F.monotonically_increasing_id().alias("row_no"), number.alias("id"), shifted.alias("label"), floored(vector, scale).alias("vec")), "vectors")
    tree = index(rows)
    if not tree.tiles.shape.rows:
        return df.sparkSession.createDataFrame([], "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, "
                                                   "positive_score bigint, negative_score bigint")
    anchors = stored(rows.filter(F.col("id") % every == 0), "anchors")
    everywhere = anchors.select(F.col("row_no").alias("item"), "row_no", "label", "vec", F.lit(-_MOST).alias("low"), F.lit(_MOST).alias("high"),
                                F.lit(True).alias("same"))
    near = search(tree, everywhere, positives).select(
        F.col("item").alias("anchor"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    near = stored(near.filter("positive_score >= 0").withColumns({
        "low": F.expr(f"cast((positive_score * {window[0]} + 99) div 100 as double)"),
        "high": F.expr(f"cast(positive_score * {window[1]} div 100 as double)")}), "positives")
    # positives of one score share their negatives
    asked = near.filter("low <= high").select("anchor", "positive_score", "low", "high").distinct()
    items = stored(asked.join(anchors.select(F.col("row_no").alias("anchor"), "label", "vec", F.col("id").alias("anchor_id")), "anchor").select(
        F.monotonically_increasing_id().alias("item"), F.col("anchor").alias("row_no"), "anchor_id", "positive_score", "label", "vec", "low",
        "high", F.lit(False).alias("same")), "windows")
    far = search(tree, items, negatives).select("item", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    held = items.select("item", F.col("row_no").alias("anchor"), "anchor_id", "positive_score")
    return near.select("anchor", "positive_id", "positive_score").join(held, ["anchor", "positive_score"]).join(far, "item").select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
