"""Packing documents into token sequences by cutting-stock column generation.

A document's tokens are cut into full sequences, one piece that is a multiple of ``QUANTUM``, and a
rest below it. The pieces' lengths make a histogram of at most capacity / QUANTUM + QUANTUM
classes; only the histogram goes to the driver, which returns patterns (see cutting_stock).
Pieces are ranked inside their class, and a pattern takes consecutive ranks, so a piece
finds its sequence and place from its rank alone. Ranks are counted per (class, bucket), so a class
that a third of the documents share is never in one task.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import cutting_stock
from .common import offsets, power_of_two, stored, text_or_empty

CAPACITY = 4096
QUANTUM = 16
END = 2
#: Pieces per bucket that the number of rank buckets aims at.
BUCKET_ROWS = 4096
#: Distinct words and pieces whose ids a worker remembers.
MEMO_WORDS = 150_000


class Memo(dict):
    """Remembers what ``make`` gave for a key, for between ``limit`` and twice as many of the latest keys."""

    def __init__(self, make, limit: int = MEMO_WORDS):
        self.make, self.limit, self.older = make, limit, {}

    def __missing__(self, key):
        out = self.older.get(key)
        if out is None:
            out = self.make(key)
        if len(self) >= self.limit:
            self.older = dict(self)
            self.clear()
        self[key] = out
        return out


class WordIds:
    """Token ids (little-endian bytes) of runs without ASCII white space.

    The tokenizer splits at white space and looks at nothing across it, so a text's ids are those of its runs in a row.
    Of a run of plain Latin-1 characters, lower-casing and the split into letter runs, digits and signs are done here,
    and only pieces not seen lately go to the model; every other run goes through the whole tokenizer.
    """

    #: The tokenizer's split pattern, and the bytes that its byte alphabet keeps as they are.
    SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    KEPT_BYTES = (*range(33, 127), *range(161, 173), *range(174, 256))
    PLAIN = re.compile("[!-~\xa1-\xff]+")
    #: The steps of the tokenizer file that this class does itself.
    STEPS = {
        "normalizer": {"type": "Sequence", "normalizers": [
            {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
        "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": SPLIT}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
    }

    @classmethod
    def check(cls, path: str) -> None:
        """Refuse a file whose steps differ: its ids would be wrong."""
        with open(path, encoding="utf-8") as file:
            steps = json.load(file)
        for name, expected in cls.STEPS.items():
            if steps.get(name) != expected:
                raise ValueError(f"the {name} of {path} is not the one that packing knows: {str(steps.get(name))[:200]}")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.check(path)
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.split = regex.compile(self.SPLIT).findall
        others = [b for b in range(256) if b not in self.KEPT_BYTES]
        self.alphabet = {b: 256 + i for i, b in enumerate(others)}
        self.four = [i.to_bytes(4, "little") for i in range(self.tokenizer.get_vocab_size())]
        self.pieces = Memo(self._piece)
        self.words = Memo(self._word)

    def _piece(self, piece: bytes) -> bytes:
        shown = piece.decode() if piece.isalpha() else piece.decode("latin-1").translate(self.alphabet)
        four = self.four
        return b"".join([four[t.id] for t in self.model.tokenize(shown)])

    def _word(self, word: bytes) -> bytes:
        if word.isalpha():  # of bytes: ASCII letters only
            return self.pieces[word.lower()]
        if word[-1] in b".,;:!?" and word[:-1].isalpha():
            return self.pieces[word[:-1].lower()] + self.pieces[word[-1:]]
        text = word.decode()
        if self.PLAIN.fullmatch(text) and "<|" not in text:  # the special tokens start so
            return b"".join([self.pieces[p.encode()] for p in self.split(text.lower())])
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def document(self, text: str) -> bytes:
        """Ids of a text and the end token."""
        words = self.words
        return b"".join([words[w] for w in text.encode().split()]) + END.to_bytes(4, "little")


_loaded: dict[str, WordIds] = {}


def cuts(tokens: int, capacity: int = CAPACITY, quantum: int = QUANTUM) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces."""
    full = tokens // capacity * capacity
    even = full + (tokens - full) // quantum * quantum
    edges = [*range(0, full + 1, capacity), even, tokens]
    return [(a, b - a) for a, b in zip(edges, edges[1:]) if b > a]


_PIECE = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"


def _pieces(path: str, capacity: int, quantum: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _loaded.get(path) or _loaded.setdefault(path, WordIds(path))
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                raw = words.document(text.as_py())
                total = len(raw) // 4
                rows += [(doc_id, a, n, zlib.crc32(raw[4 * a:4 * (a + n)]), total)
                         for a, n in cuts(total, capacity, quantum)]
            names = [c.split(" ")[0] for c in _PIECE.split(", ")]
            yield pa.record_batch({c: pa.array([r[i] for r in rows], pa.int64()) for i, c in enumerate(names)})

    return cut


def pack(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY,
         quantum: int = QUANTUM) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A null or empty text is the end token alone. Ids may be null or repeat; every row is a document. Ties are
    broken by the row's place, so they only decide which equal-length piece goes where. Other columns are
    ignored; an empty table gives no rows. ``tokenizer`` is a path that every executor can open; a file
    with another normaliser or split than WordIds does is refused.
    """
    WordIds.check(tokenizer)
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), text_or_empty(text).alias("text"))
    pieces = stored(rows.mapInArrow(_pieces(tokenizer, capacity, quantum), _PIECE).withColumn(
        "row_no", F.monotonically_increasing_id()), "pieces")
    total = pieces.count()
    buckets = power_of_two(total / BUCKET_ROWS, 64, 1 << 16)
    ranked = pieces.withColumn("bucket", F.pmod(F.xxhash64("row_no"), F.lit(buckets)))
    per_bucket = stored(ranked.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n")), "piece-counts")
    histogram = sorted((r["length"], r["n"]) for r in per_bucket.groupBy("length").agg(F.sum("n").alias("n")).collect())
    sizes, counts = [s for s, _ in histogram], [n for _, n in histogram]

    # Where each use of a class by a pattern begins: in the ranks of the class, in the sequences, in the sequence.
    taken, sequences, uses = dict.fromkeys(sizes, 0), 0, []
    for pattern, times in cutting_stock.plan(sizes, counts, capacity, quantum) if sizes else []:
        offset = 0
        for k in np.flatnonzero(pattern):
            size, n = sizes[k], int(pattern[k])
            uses.append((size, taken[size], taken[size] + n * times, n, sequences, offset))
            taken[size] += n * times
            offset += n * size
        sequences += times
    uses = docs.sparkSession.createDataFrame(
        uses, "length bigint, first bigint, after bigint, per bigint, sequence bigint, at bigint")

    inside = Window.partitionBy("length", "bucket").orderBy("row_no")
    ranks = ranked.withColumn("rank", F.row_number().over(inside) - 1).join(
        offsets(per_bucket, ["length"], "bucket", "n", "base"), ["length", "bucket"]).withColumn(
            "rank", F.col("rank") + F.col("base")).drop("base", "bucket", "row_no")
    # One row per (pattern, class): bounded by the classes, not by the documents.
    uses = F.broadcast(uses.withColumnRenamed("length", "size"))
    step = F.col("rank") - F.col("first")
    return ranks.join(uses, (F.col("length") == F.col("size")) & step.between(0, F.col("after") - F.col("first") - 1)).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens",
        (F.col("sequence") + F.floor(step / F.col("per"))).alias("sequence_id"),
        (F.col("at") + F.pmod(step, F.col("per")) * F.col("length")).alias("offset"))
