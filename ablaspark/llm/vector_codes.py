"""Vector codes: each part of a vector becomes the index of its nearest codebook entry, found through memoised grid cells.

A part is an integer vector; its coarse cell is the box of a grid that it lies in. For a box, an entry is dominated if its least
distance to the box exceeds the greatest distance of another entry: no point of the box can choose it. The entries that are not
dominated are found once per cell and kept under the cell's hash; a part then compares itself exactly with those of its cell
only. The codebooks follow by rounds of means: every task sends one sum per part, entry and position.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import small_side
from .common import stored
from .vectors import floored, matrix, shape_of, slices, usable

PARTS, ENTRIES, ROUNDS = 8, 16, 6
#: A grid cell is as wide as a component's spread among the entries divided by this (rounded to a power of two).
CELLS = 4
#: Cells that a task remembers per part; beyond, it starts anew (results don't depend on it).
MEMORY = 1 << 16
_BLOCK = 4096
#: Components beyond this are refused: squared distances of a part must be exact in 63 bits.
MOST = 1 << 28


class Grid:
    """The entries of one part, and per coarse cell those that some point of the cell may choose."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        spread = int((entries.max(axis=0) - entries.min(axis=0)).max())
        self.shift = max(0, (spread // CELLS).bit_length() - 1) if spread else 0
        self.weights = np.random.default_rng(entries.shape[1]).integers(1, 1 << 62, entries.shape[1]) | 1
        self._forget()

    def _forget(self) -> None:
        """Hashes of the known cells (sorted), the cells, and their candidates."""
        width = self.entries.shape[1]
        self.keys, self.cells, self.bits = np.empty(0, np.int64), np.empty((0, width), np.int64), np.empty(0, np.int64)

    def _candidates(self, cells: np.ndarray) -> np.ndarray:
        """A bit per entry that is not dominated across the cell."""
        low = (cells << self.shift)[:, None, :] - self.entries  # (cell, entry, position): the entry's offset to the box
        high = low + ((1 << self.shift) - 1)
        near = np.where(low > 0, low, np.where(high < 0, high, 0))
        far = np.maximum(np.abs(low), np.abs(high))
        least, most = (near * near).sum(axis=2), (far * far).sum(axis=2)
        return (least <= most.min(axis=1)[:, None]) @ (1 << np.arange(len(self.entries)))

    def masks(self, parts: np.ndarray) -> np.ndarray:
        """The candidates of each part's cell; all entries where another cell has the same hash."""
        cells = parts >> self.shift
        keys = cells @ self.weights
        seen, first = np.unique(keys, return_index=True)
        new = first[~np.isin(seen, self.keys)]
        if len(self.keys) + len(new) > MEMORY:
            self._forget()
            new = first
        if len(new):
            bits = [self._candidates(cells[new[some]]) for some in slices(len(new), _BLOCK)]
            order = np.argsort(held := np.concatenate((self.keys, keys[new])))
            self.keys, self.cells = held[order], np.concatenate((self.cells, cells[new]))[order]
            self.bits = np.concatenate((self.bits, *bits))[order]
        at = np.searchsorted(self.keys, keys)
        return np.where((self.cells[at] == cells).all(axis=1), self.bits[at], (1 << len(self.entries)) - 1)

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index, squared distance) of the nearest entry, ties to the lower index."""
        masks = self.masks(parts)
        index, error = np.zeros(len(parts), np.int64), np.full(len(parts), np.iinfo(np.int64).max)
        for e, entry in enumerate(self.entries):
            rows = np.flatnonzero(masks >> e & 1)
            away = parts[rows] - entry
            away = (away * away).sum(axis=1)
            better = away < error[rows]
            index[rows[better]], error[rows[better]] = e, away[better]
        return index, error


class Codebooks(NamedTuple):
    """entries[part]: one row per entry."""

    entries: list[np.ndarray]

    @property
    def width(self) -> int:
        return self.entries[0].shape[1]

    def parts(self, column: pa.Array) -> list[np.ndarray]:
        whole = matrix(column, PARTS * self.width, np.int64)
        return np.split(whole, PARTS, axis=1)

    def digest(self) -> str:
        return hashlib.sha256(",".join(str(int(x)) for e in self.entries for x in e.ravel()).encode()).hexdigest()


def _sums(books: Codebooks):
    """Of a partition, per part, entry and position the sum, and the count."""
    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grids = [Grid(e) for e in books.entries]
        n = len(books.entries[0])
        total, count = np.zeros((PARTS, n, books.width), np.int64), np.zeros((PARTS, n), np.int64)
        for batch in batches:
            for some in slices(batch.num_rows, _BLOCK):
                for p, x in enumerate(books.parts(batch.column("vec").slice(some.start, some.stop - some.start))):
                    index, _ = grids[p].nearest(x)
                    np.add.at(total[p], index, x)
                    count[p] += np.bincount(index, minlength=n)
        p, e, j = np.indices(total.shape).reshape(3, -1)
        used = count[p, e] > 0
        yield pa.record_batch({"part": pa.array(p[used]), "entry": pa.array(e[used]), "pos": pa.array(j[used]),
                               "total": pa.array(total.ravel()[used]), "n": pa.array(count[p, e][used])})

    return fold


def _refined(vectors: DataFrame, books: Codebooks) -> Codebooks:
    sums = vectors.select("vec").mapInArrow(_sums(books), "part bigint, entry bigint, pos bigint, total bigint, n bigint").groupBy(
        "part", "entry", "pos").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n"))
    entries = [e.copy() for e in books.entries]
    for r in sums.collect():  # at most PARTS x ENTRIES x width rows
        entries[r["part"]][r["entry"], r["pos"]] = int(r["total"]) // r["n"]
    return Codebooks(entries)


def train(vectors: DataFrame, width: int, rounds: int = ROUNDS, entries: int = ENTRIES) -> Codebooks:
    """Codebooks of ``vectors`` (id, vec; stored): they start as the parts of the rows with the smallest ids."""
    heads = vectors.orderBy(F.asc_nulls_last("id"), "vec").limit(entries).select("vec").collect()
    start = matrix(pa.array([r["vec"] for r in heads], pa.list_(pa.int64())), PARTS * width, np.int64)
    books = Codebooks(np.split(start, PARTS, axis=1))
    for _ in range(rounds):
        books = _refined(vectors, books)
    return books


def _encoded(books: Codebooks):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grids = [Grid(e) for e in books.entries]
        for batch in batches:
            for some in slices(batch.num_rows, _BLOCK):
                part = batch.slice(some.start, some.stop - some.start)
                found = [g.nearest(x) for g, x in zip(grids, books.parts(part.column("vec")))]
                codes = np.stack([index for index, _ in found], axis=1).astype(np.uint8)
                yield pa.record_batch({"id": part.column("id"), "label": part.column("label"), "code": pa.array([c.tobytes().hex() for c in codes]),
                                       "error": pa.array(sum(error for _, error in found))})

    return encode


def codes(df: DataFrame, scale: int = 4096, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """vec_id, code (two hex digits a part), error, label_error, codebooks_sha256 of every usable row.

    Components are floor(scale * x). Rows without a vector or with a null or non-finite component are left out. Vectors are as long as
    the longest, rounded up to a multiple of the number of parts; shorter ones end in zeros. Codebooks start from the rows with the
    smallest ids (null last; rows that share an id by their vectors), fewer than 16 rows give fewer entries, equal entries are served by the
    lower index. label_error sums the error over equal labels, null labels together. Rows that share an id are different rows. Other
    columns are ignored, an empty table gives no rows, components beyond 2^28 are refused.
    """
    vectors = stored(df.filter(usable(vector)).select(
        F.col(vec_id).cast("bigint").alias("id"), F.col(label).alias("label"), floored(vector, scale).alias("vec")), "vectors")
    shape = shape_of(vectors)
    if shape.largest > MOST:
        raise ValueError(f"components up to {shape.largest} are beyond {MOST}")
    if not shape.rows:
        return df.sparkSession.createDataFrame([], "vec_id bigint, code string, error bigint, label_error bigint, codebooks_sha256 string")
    books = train(vectors, max(1, -(-shape.dim // PARTS)))
    kind = vectors.schema["label"].dataType.simpleString()
    coded = stored(vectors.mapInArrow(_encoded(books), f"id bigint, label {kind}, code string, error bigint"), "codes")
    totals = stored(coded.groupBy("label").agg(F.sum("error").alias("label_error")), "label-errors")
    total = small_side(totals.withColumnRenamed("label", "same"))
    return coded.join(total, coded["label"].eqNullSafe(total["same"])).select(
        F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))
