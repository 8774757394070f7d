"""SimHash near-duplicates by a self-join of a binary trie.

If two fingerprints differ in at most four bits, they differ in at most two of the first half, or in at
most one of the second. So the trie is joined with itself twice, once over each order of the
halves, with the smaller budget for the first 32 levels. The upper levels are traversed by
Spark: a cell is a prefix, every fingerprint goes to the pairs of cells within the budget,
and a task goes on below such a pair (see trie_join). Cells with many fingerprints are divided
further; exact copies are one fingerprint. Tasks return a forest over their links, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import numbered, one_of_each, stored, text_or_empty
from .components import components
from .trie_join import link, masks

SHINGLE = 4
BUDGET = 4
SEED = 42
#: (budget in the first half, rotation) of the two joins; any pair within BUDGET is in one of them.
JOINS = ((2, 0), (1, 32))
#: Fingerprints per cell; cells above are divided, and at most 2 x rows / CELL prefixes are sent to the tasks.
CELL = 1 << 18
LEAST_DEPTH, MOST_DEPTH, STEP = 5, 20, 4
_PART = 1 << 16


def simhash(text: str, shingle: int = SHINGLE) -> int:
    """64-bit fingerprint of the word shingles of a text lower-cased in A-Z; 0 without words."""
    words = text.encode().lower().split()  # bytes: ASCII white space and letters only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate(([0], ends[:-1]))
    n = max(1, len(words) - shingle + 1)
    firsts, lasts = starts[:n].tolist(), (ends[-n:] - 1).tolist()
    ones = np.zeros(64, dtype=np.int64)
    for a in range(0, n, _PART):
        hashed = [xxhash.xxh64_intdigest(joined[i:j], SEED) for i, j in zip(firsts[a:a + _PART], lasts[a:a + _PART])]
        bits = np.unpackbits(np.array(hashed, dtype=">u8").view(np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def _fingerprint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = np.array([simhash(t.as_py()) for t in batch.column("text")], dtype=np.uint64)
        yield pa.record_batch({"doc_id": batch.column("doc_id"), "print": pa.array(prints.view(np.int64))})


def _rotated(prints: np.ndarray, by: int) -> np.ndarray:
    return prints if not by else (prints << np.uint64(by)) | (prints >> np.uint64(64 - by))


def _router(depths: list[int], heavy: dict[tuple[int, int], np.ndarray]):
    """Send each fingerprint to the cell pairs that it belongs to, once per pair."""
    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            prints = batch["print"].to_numpy().view(np.uint64)
            for budget, by in JOINS:
                keys = _rotated(prints, by)
                for level, depth in enumerate(depths):
                    cell = keys >> np.uint64(64 - depth)
                    for mask in masks(depth, budget):
                        other = cell ^ mask
                        dense = _dense(heavy, by, depth, cell, other)
                        go = np.ones(len(keys), bool) if level == len(depths) - 1 else ~dense
                        if level:
                            up = np.uint64(depth - depths[level - 1])
                            go &= _dense(heavy, by, depths[level - 1], cell >> up, other >> up)
                        if go.any():
                            yield _blobs(by, depth, np.minimum(cell, other)[go], np.maximum(cell, other)[go], keys[go])

    return route


def _dense(heavy, by, depth, cell, other) -> np.ndarray:
    known = heavy.get((by, depth))
    return np.isin(cell, known) | np.isin(other, known) if known is not None else np.zeros(len(cell), bool)


def _blobs(by: int, depth: int, a: np.ndarray, b: np.ndarray, keys: np.ndarray) -> pd.DataFrame:
    order = np.lexsort((b, a))
    a, b, keys = a[order], b[order], keys[order]
    cuts = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]))))
    return pd.DataFrame({"by": by, "depth": depth, "a": a[cuts].astype(np.int64), "b": b[cuts].astype(np.int64),
                         "keys": [k.tobytes() for k in np.split(keys, cuts[1:])]})


def _join(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
    by, depth, a, b = map(int, key)
    keys = np.unique(np.frombuffer(b"".join(group["keys"]), dtype=np.uint64))
    n = len(keys)
    budget = dict((r, h) for h, r in JOINS)[by]
    if a == b:
        start = [(0, n, 0, n, 0)]
    else:
        middle = int(np.searchsorted(keys >> np.uint64(64 - depth), np.uint64(b)))
        start = [(0, middle, middle, n, int(a ^ b).bit_count())] if 0 < middle < n else []
    i, j = link(keys, start, depth, BUDGET, budget)
    back = _rotated(keys, (64 - by) % 64).view(np.int64)
    return pd.DataFrame({"a": back[i], "b": back[j]})


def linked_prints(prints: DataFrame) -> DataFrame:
    """Edges (a, b) that connect exactly the fingerprints (column print, distinct) linked directly or by others."""
    n = prints.count()
    depth = min(16, max(LEAST_DEPTH, (n // CELL).bit_length()))
    depths, heavy = [depth], {}
    while True:
        crowded = {}
        for _, by in JOINS:
            key = F.col("print") if not by else F.expr(f"shiftleft(print, {by}) | shiftrightunsigned(print, {64 - by})")
            full = prints.groupBy(F.shiftrightunsigned(key, 64 - depths[-1]).alias("cell")).count().filter(
                F.col("count") > CELL)
            # at most rows / CELL cells
            if cells := [r["cell"] for r in full.collect()]:
                crowded[by, depths[-1]] = np.array(cells, dtype=np.int64).view(np.uint64)
        if not crowded or depths[-1] >= MOST_DEPTH:
            break
        heavy |= crowded
        depths.append(min(MOST_DEPTH, depths[-1] + STEP))
    routed = prints.select("print").mapInPandas(_router(depths, heavy), "by int, depth int, a bigint, b bigint, keys binary")
    return routed.groupBy("by", "depth", "a", "b").applyInPandas(_join, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (16 hex digits), component_id.

    The component is the smallest id that links of at most ``BUDGET`` differing bits reach. A null text
    and one without words have fingerprint 0 and are linked like any other. Null ids never are a
    component's id unless it has no other. Repeated rows are rows of their own. Other columns are ignored;
    an empty table gives no rows.
    """
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), text_or_empty(text).alias("text"))
    marked = stored(rows.mapInArrow(_fingerprint, "doc_id bigint, print bigint"), "simhash")
    groups = stored(marked.groupBy("print").agg(F.min("doc_id").alias("first")), "simhash-prints")
    roots = components(linked_prints(groups))
    labelled = stored(groups.join(roots.withColumnRenamed("node", "print"), "print", "left").select(
        "print", "first", F.coalesce("root", "print").alias("root")), "simhash-roots")
    least = labelled.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = stored(labelled.join(least, "root").select("print", "component_id"), "simhash-classes")
    return marked.join(classes, "print").select(
        "doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, with one document of every group: that of the smallest id.

    Null ids come last; of rows that tie exactly one stays.
    """
    held = numbered(docs)
    marked = near_duplicates(held.select("row_no", F.col("row")[text].alias("text")), "row_no", "text")
    return one_of_each(held, marked.select(F.col("doc_id").alias("row_no"), F.col("component_id").alias("root")), doc_id)
