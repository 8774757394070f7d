"""Exact top-k inner products by a Voronoi kNN join.

A vector x becomes x' = (x, sqrt(M^2 - |x|^2)), where M is the largest norm, and a query q' = (q, 0). Then
|q' - x'|^2 = |q|^2 + M^2 - 2<q, x>, so the highest inner products are the nearest neighbours, and the triangle
inequality holds. Pivots p are vectors of the table. Each row joins the cell of its nearest pivot, each query the cell of
its own. Per cell a summary is kept: rows, the least and greatest distance of a row to the pivot, the k + 1 least
distances, and the greatest distance U of a query. They bound the distance to which a query cell i must look:

    T(i) = the (k+1)-th least of  U(i) + |p_i - p_j| + d  over the least distances d of all cells j

(one more than k, since the query's own row may be among them). A row at distance d from p_j can only matter to cell i if
d >= |p_i - p_j| - U(i) - T(i). Cells that lie together form query groups; a row is sent to the groups that need it, and
each group looks at its rows cell by cell, nearest first, leaving out the queries that a cell can't help. Hot cells and
large groups are dealt out: a group's queries in parts, its rows in shards.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import power_of_two, stored
from .vectors import Best, Shape, by_task, floored, ids_of, lists, matrix, runs, shape_of, slices, usable

#: At most so many pivots, hence cells; summaries and the table of cells and groups are bounded by its square.
PIVOTS = 1 << 10
#: Queries of a group's part, rows of a group's shard (about: rows are dealt by their number).
QUERIES, ROWS = 4096, 1 << 14
#: Rows and queries that are multiplied at once.
_BLOCK = 2048
#: Distances are rounded; bounds give way by this share of the largest norm.
SLACK = 1e-6


class Cells(NamedTuple):
    """Pivots with their last component, and the largest norm."""

    pivots: np.ndarray
    last: np.ndarray
    norm: float
    shape: Shape

    def distances(self, x: np.ndarray, query: bool) -> np.ndarray:
        own = (x * x).sum(axis=1)
        away = np.zeros(len(x)) if query else np.sqrt(np.maximum(0, self.norm ** 2 - own))
        apart = (own if query else np.full(len(x), self.norm ** 2))[:, None] + self.norm ** 2 - 2 * (
            x @ self.pivots.T + away[:, None] * self.last)
        return np.sqrt(np.maximum(0, apart))


class Plan(NamedTuple):
    """Which rows each query group needs, and in which tasks it meets them."""

    bound: np.ndarray  # per cell: how far its queries look
    group: np.ndarray  # per cell: the group of its queries, -1 without queries
    needs: np.ndarray  # group x cell: the least distance to the pivot of a row that matters
    place: np.ndarray  # group x cell: nearest cells first
    parts: np.ndarray
    shards: np.ndarray

    def first(self) -> np.ndarray:
        """The first task of each group, and the number of tasks."""
        return np.concatenate(([0], np.cumsum(self.parts * self.shards)))


def _cells(rows: DataFrame, shape: Shape) -> Cells:
    """Of each hash bucket one vector: distinct, and the same whatever the partitions."""
    buckets = power_of_two(shape.rows ** 0.5, 4, PIVOTS)
    hashed = rows.select("vec", F.xxhash64("vec").alias("h"))
    picked = hashed.groupBy(F.pmod("h", F.lit(buckets)).alias("b")).agg(F.min_by("vec", "h").alias("vec")).orderBy("b")
    table = pa.array([r["vec"] for r in picked.collect()], pa.list_(pa.int64()))  # at most PIVOTS rows
    square = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x.cast("double") * x)
    norm = float(rows.agg(F.max(square)).first()[0]) ** 0.5
    pivots = matrix(table, shape.dim)
    return Cells(pivots, np.sqrt(np.maximum(0, norm ** 2 - (pivots ** 2).sum(axis=1))), norm, shape)


def _assigned(cells: Cells, every: int):
    """Adds to each row its cell and distance, to each query also the cell and distance of the query."""
    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch.num_rows, _BLOCK):
                some = batch.slice(part.start, part.stop - part.start)
                x = matrix(some.column("vec"), cells.shape.dim)
                ids, null = ids_of(some.column("id"))
                away, asks = cells.distances(x, False), ~null & (ids % every == 0)
                cell = away.argmin(axis=1)
                q_cell, q_dist = np.zeros(len(x), np.int64), np.zeros(len(x))
                if asks.any():
                    seen = cells.distances(x[asks], True)
                    q_cell[asks], q_dist[asks] = seen.argmin(axis=1), seen.min(axis=1)
                yield pa.record_batch({"row_no": some.column("row_no"), "id": some.column("id"), "vec": some.column("vec"),
                                       "cell": pa.array(cell.astype(np.int32)), "dist": pa.array(away[np.arange(len(x)), cell]),
                                       "q_cell": pa.array(q_cell.astype(np.int32), mask=~asks), "q_dist": pa.array(q_dist, mask=~asks)})

    return assign


def _summaries(count: int, k: int):
    """Of a partition, per cell: rows, least and greatest distance, k + 1 least distances, queries, greatest query distance."""
    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, asks = np.zeros(count, np.int64), np.zeros(count, np.int64)
        high, reach = np.full(count, -np.inf), np.full(count, -np.inf)
        least = [np.empty(0)] * count
        for batch in batches:
            cell, dist = (batch.column(c).to_numpy() for c in ("cell", "dist"))
            rows += np.bincount(cell, minlength=count)
            np.maximum.at(high, cell, dist)
            for c in np.unique(cell):
                least[c] = np.sort(np.concatenate((least[c], dist[cell == c])))[:k + 1]
            is_query = batch.column("q_cell").is_valid().to_numpy(zero_copy_only=False)
            q_cell, q_dist = (batch.column(c).fill_null(0).to_numpy()[is_query] for c in ("q_cell", "q_dist"))
            asks += np.bincount(q_cell, minlength=count)
            np.maximum.at(reach, q_cell, q_dist)
        seen = np.flatnonzero(rows + asks)
        yield pa.record_batch({"cell": pa.array(seen), "rows": pa.array(rows[seen]), "high": pa.array(high[seen]),
                               "least": pa.array([least[c] for c in seen], pa.list_(pa.float64())),
                               "asks": pa.array(asks[seen]), "reach": pa.array(reach[seen])})

    return fold


def _plan(assigned: DataFrame, cells: Cells, k: int) -> Plan:
    """From the summaries of all cells, at most PIVOTS rows."""
    n = len(cells.pivots)
    schema = "cell bigint, rows bigint, high double, least array<double>, asks bigint, reach double"
    partial = assigned.select("cell", "dist", "q_cell", "q_dist").mapInArrow(_summaries(n, k), schema)
    merged = partial.groupBy("cell").agg(
        F.sum("rows").alias("rows"), F.max("high").alias("high"), F.sum("asks").alias("asks"), F.max("reach").alias("reach"),
        F.slice(F.sort_array(F.flatten(F.collect_list("least"))), 1, k + 1).alias("least"))
    rows, asks, high, reach = np.zeros(n, np.int64), np.zeros(n, np.int64), np.full(n, -np.inf), np.full(n, -np.inf)
    of, least = [], []
    for r in merged.collect():
        rows[r["cell"]], asks[r["cell"]], high[r["cell"]], reach[r["cell"]] = r["rows"], r["asks"], r["high"], r["reach"]
        of += [r["cell"]] * len(r["least"])
        least += r["least"]

    slack = SLACK * max(cells.norm, 1.0)
    full = np.hstack((cells.pivots, cells.last[:, None]))
    square = (full ** 2).sum(axis=1)
    apart = np.sqrt(np.maximum(0, square[:, None] + square - 2 * full @ full.T))
    bound = reach + (np.partition(apart[:, of] + np.array(least), k, axis=1)[:, k] if len(least) > k else np.inf) + slack
    needs = apart - (reach + bound)[:, None] - slack

    group, alike = np.full(n, -1), []
    left = set(np.flatnonzero(asks).tolist())
    while left:  # the cell with most queries, and cells near to it until the group is full
        head = max(left, key=lambda c: (asks[c], -c))
        mine, size = [], 0
        for c in sorted(left, key=lambda c: apart[head, c]):
            if mine and size + asks[c] > QUERIES:
                break
            mine.append(c)
            size += asks[c]
        group[mine] = len(alike)
        alike.append(mine)
        left.difference_update(mine)
    g_needs = np.array([needs[mine].min(axis=0) for mine in alike]).reshape(-1, n)
    place = np.array([apart[mine[0]].argsort().argsort() for mine in alike]).reshape(-1, n)
    parts = np.array([-(-int(asks[mine].sum()) // QUERIES) for mine in alike], np.int64)
    shards = np.array([-(-int(rows[high >= need].sum()) // ROWS) for need in g_needs], np.int64)
    return Plan(bound, group, g_needs, place, parts, np.maximum(shards, 1))


def _sent(plan: Plan, width: int):
    """Each row with the tasks that need it, as task * width + place of its cell; queries come first, at place 0."""
    first = plan.first()

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row_no, cell, dist = (batch.column(c).to_numpy() for c in ("row_no", "cell", "dist"))
            q_cell = batch.column("q_cell").fill_null(-1).to_numpy()
            n, at, to, asks, asked = len(row_no), [], [], [], []
            for g in range(len(plan.parts)):
                parts, shards = int(plan.parts[g]), int(plan.shards[g])
                some = np.flatnonzero(dist >= plan.needs[g, cell])
                for p in range(parts):
                    at.append(some)
                    to.append((first[g] + p * shards + row_no[some] % shards) * width + 1 + plan.place[g, cell[some]])
                some = np.flatnonzero((q_cell >= 0) & (plan.group[q_cell] == g))
                for s in range(shards if len(some) else 0):
                    asks.append(some)
                    asked.append((first[g] + row_no[some] % parts * shards + s) * width)
            empty = [np.empty(0, np.int64)]
            yield pa.record_batch({
                "row_no": batch.column("row_no"), "id": batch.column("id"), "vec": batch.column("vec"), "cell": batch.column("cell"),
                "dist": batch.column("dist"), "q_cell": batch.column("q_cell"),
                "sent": lists(np.concatenate(at + asks + empty), np.concatenate(to + asked + empty), n)})

    return send


def _solve(cells: Cells, plan: Plan, k: int):
    """The k best rows of each task's queries among its rows."""
    slack = SLACK * max(cells.norm, 1.0)

    class Task:
        def __init__(self):
            self.rows, self.ids, self.vecs, self.far, self.bounds, self.best = [], [], [], [], [], None

        def query(self, batch: pa.RecordBatch) -> None:
            q = matrix(batch.column("vec"), cells.shape.dim)
            self.rows.append(batch.column("row_no").to_numpy())
            self.ids.append(batch.column("id").to_numpy())
            self.vecs.append(q)
            self.far.append(cells.distances(q, True))
            self.bounds.append(plan.bound[batch.column("q_cell").to_numpy()])

        def ready(self) -> None:
            self.rows, self.ids, self.vecs, self.far, self.bounds = (
                np.concatenate(x) for x in (self.rows, self.ids, self.vecs, self.far, self.bounds))
            self.best = Best(len(self.rows), k)
            self.level = (self.vecs ** 2).sum(axis=1) + cells.norm ** 2

        def row(self, batch: pa.RecordBatch) -> None:
            if not len(self.rows):
                return
            if self.best is None:
                self.ready()
            x, away = matrix(batch.column("vec"), cells.shape.dim), batch.column("dist").to_numpy()
            ids, null = ids_of(batch.column("id"))
            row_no = batch.column("row_no").to_numpy()
            # how far away each query's k-th best row is, once it has k
            kth = self.best.kth()
            look = np.minimum(self.bounds, np.sqrt(np.maximum(0, self.level - 2 * np.maximum(kth, -1e300))))
            d = self.far[:, batch.column("cell")[0].as_py()]
            items = np.flatnonzero(np.maximum(d - away.max(), away.min() - d) <= look + slack)
            for some in slices(len(items), _BLOCK):
                mine = items[some]
                scores = self.vecs[mine] @ x.T
                scores[self.rows[mine][:, None] == row_no] = -np.inf
                self.best.offer(mine, scores, ids, null, row_no)

        def found(self) -> Iterator[pa.RecordBatch]:
            if self.best is not None:
                yield self.best.found({"query_no": self.rows, "query_id": self.ids})

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, task = None, Task()
        width = len(cells.pivots) + 1
        for key, run in runs(batches, "to"):
            number, place = divmod(key, width)
            if number != now:
                yield from task.found()
                now, task = number, Task()
            for some in slices(run.num_rows, _BLOCK):
                (task.row if place else task.query)(run.slice(some.start, some.stop - some.start))
        yield from task.found()

    return solve


FOUND = "query_no bigint, query_id bigint, id bigint, row_no bigint, score bigint"


def top_k(df: DataFrame, k: int = 5, every: int = 50, scale: int = 256, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: of each row whose id is divisible by ``every`` the k other rows with the highest inner product.

    Components are floor(scale * x); ties go to the smaller id, a null id last. Rows without a vector or with a null or non-finite
    component take no part. A row, not an id, is a query and is left out of its own answer: rows that share an id are each other's
    candidates. A null id is no query. Shorter vectors count as ending in zeros. Other columns are ignored, an empty table gives
    no rows. Vectors whose inner products could exceed 53 bits are refused.
    """
    rows = df.filter(usable(vector)).select(F.col(vec_id).cast("bigint").alias("id"), floored(vector, scale).alias("vec"))
    shape = shape_of(rows).checked()
    result = "query_id bigint, rank int, vec_id bigint, score bigint"
    if not shape.rows:
        return df.sparkSession.createDataFrame([], result)
    cells = _cells(rows, shape)
    assigned = stored(rows.withColumn("row_no", F.monotonically_increasing_id()).select("row_no", "id", "vec").mapInArrow(
        _assigned(cells, every), "row_no bigint, id bigint, vec array<bigint>, cell int, dist double, q_cell int, q_dist double"), "voronoi")
    plan = _plan(assigned, cells, k)
    width = len(cells.pivots) + 1
    sent = assigned.drop("q_dist").mapInArrow(
        _sent(plan, width), "row_no bigint, id bigint, vec array<bigint>, cell int, dist double, q_cell int, sent array<bigint>")
    dealt = by_task(sent.select("row_no", "id", "vec", "cell", "dist", "q_cell", F.explode("sent").alias("to")).withColumn(
        "task", F.floor(F.col("to") / width)), int(plan.first()[-1]), "task", ["to"])
    found = dealt.mapInArrow(_solve(cells, plan, k), FOUND)
    # a query has k rows of each shard at most
    rank = Window.partitionBy("query_no").orderBy(F.desc("score"), F.asc_nulls_last("id"), "row_no")
    return found.withColumn("rank", F.row_number().over(rank)).filter(F.col("rank") <= k).select(
        "query_id", "rank", F.col("id").alias("vec_id"), "score")
