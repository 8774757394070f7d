"""Integer vectors for the exact vector operators: preparation, matrices, best scores, runs of a sorted stream."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Shape(NamedTuple):
    """What a job must know of all vectors: rows, the longest, the largest absolute component."""

    rows: int
    dim: int
    largest: int

    def checked(self) -> Shape:
        """Inner products must be exact in doubles."""
        if max(self.dim, 1) * self.largest ** 2 >= 1 << 53:
            raise ValueError(f"inner products of {self.dim} components up to {self.largest} do not fit 53 bits")
        return self


def usable(vector: str) -> Column:
    """Neither the vector nor a component of it is null, NaN or infinite."""
    finite = F.forall(F.col(vector).cast("array<double>"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite, F.lit(False))


def floored(vector: str, scale: int) -> Column:
    """floor(scale * x) of every component, x as double."""
    return F.transform(F.col(vector).cast("array<double>"), lambda x: F.floor(x * float(scale)))


def shape_of(rows: DataFrame, vec: str = "vec") -> Shape:
    far = F.aggregate(vec, F.lit(0).cast("bigint"), lambda a, x: F.greatest(a, x, -x))
    return Shape(*[v or 0 for v in rows.agg(F.count(F.lit(1)), F.max(F.size(vec)), F.max(far)).first()])


def matrix(column: pa.Array, dim: int, dtype: type = np.float64) -> np.ndarray:
    """One row per vector; shorter vectors end in zeros."""
    sizes = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if (sizes == dim).all():
        return flat.reshape(len(sizes), dim).astype(dtype)
    out = np.zeros((len(sizes), dim), dtype)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def lists(rows: np.ndarray, values: np.ndarray, n: int) -> pa.ListArray:
    """values grouped by their row, a list for each of n rows."""
    order = np.argsort(rows, kind="stable")
    ends = np.concatenate(([0], np.cumsum(np.bincount(rows, minlength=n))))
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(values[order].astype(np.int64)))


def runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Slices of equal key of a stream that is sorted by it; a key may come in several slices."""
    for batch in batches:
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))).tolist() if len(keys) else []
        for a, b in zip(cuts, [*cuts[1:], len(keys)]):
            yield int(keys[a]), batch.slice(a, b - a)


class Best:
    """For each item its k best rows so far: higher scores first, ties by smaller id (null last), then row number."""

    def __init__(self, items: int, k: int):
        self.k, self.score = k, np.full((items, k), -np.inf)
        self.id, self.row = np.zeros((items, k), np.int64), np.full((items, k), -1, np.int64)
        self.null = np.zeros((items, k), bool)

    def kth(self) -> np.ndarray:
        """The score that a row must reach; minus infinity while there are fewer than k."""
        return self.score[:, -1]

    def offer(self, items: np.ndarray, scores: np.ndarray, ids: np.ndarray, null: np.ndarray, rows: np.ndarray) -> None:
        """scores: items x rows, minus infinity where a row does not count for an item."""
        if not scores.size:
            return
        least = self.kth()[items]
        if scores.shape[1] > self.k:  # what all k best of these rows beat cannot enter; ties stay
            least = np.maximum(least, np.partition(scores, -self.k, axis=1)[:, -self.k])
        at, what = np.nonzero((scores >= least[:, None]) & (scores > -np.inf))
        if not len(at):
            return
        touched = np.unique(at)
        old = np.repeat(touched, self.k)
        mine = items[touched]
        item = np.concatenate((at, old))
        score = np.concatenate((scores[at, what], self.score[mine].ravel()))
        one = np.concatenate((ids[what], self.id[mine].ravel()))
        gone = np.concatenate((null[what], self.null[mine].ravel()))
        row = np.concatenate((rows[what], self.row[mine].ravel()))
        order = np.lexsort((row, one, gone, -score, item))
        place = np.arange(len(order)) - np.searchsorted(item[order], item[order])
        keep = order[place < self.k]
        slot = (items[item[keep]], place[place < self.k])
        self.score[slot], self.id[slot], self.null[slot], self.row[slot] = score[keep], one[keep], gone[keep], row[keep]

    def found(self, items: dict[str, np.ndarray]) -> pa.RecordBatch:
        """The columns ``items`` of each item next to id, row_no and score of its best rows."""
        i, j = np.nonzero(self.score > -np.inf)
        return pa.record_batch({**{n: pa.array(v[i]) for n, v in items.items()},
                                "id": pa.array(self.id[i, j], mask=self.null[i, j]), "row_no": pa.array(self.row[i, j]),
                                "score": pa.array(self.score[i, j].astype(np.int64))})


def ids_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids, 0 for null, and which are null."""
    return column.fill_null(0).to_numpy(zero_copy_only=False), column.is_null().to_numpy(zero_copy_only=False)


def slices(n: int, most: int) -> Iterator[slice]:
    for a in range(0, n, most):
        yield slice(a, min(n, a + most))


def cuts_of(values: np.ndarray, parts: int) -> np.ndarray:
    """The parts - 1 values that cut sorted values evenly."""
    return np.sort(values)[[len(values) * p // parts for p in range(1, parts)]]


def by_task(rows: DataFrame, tasks: int, task: str, order: Sequence[str]) -> DataFrame:
    """All rows of a task number in one partition, sorted by task and ``order``."""
    most = min(max(tasks, 1), 1 << 15)
    return rows.repartitionById(most, F.pmod(F.col(task), F.lit(most)).cast("int")).sortWithinPartitions(task, *order)
