"""Questions and answers between chunks of documents and ranges of a hash space.

Some operators compare short strings of every document with those of all others. Rows per string would
be far larger than the texts, so a chunk of documents packs the hashes it asks about into one
binary row for each range of the hash space, a task for that range answers with a bit per
hash, and the answers meet the chunk's texts again. A hash is sent once per chunk however often it
occurs there, which also thins out hot strings before the shuffle. The texts are shuffled once; later
steps reuse that exchange.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import power_of_two, text_or_empty

#: Bytes of text per chunk: at least CHUNK, more for large inputs so that packed rows stay worth their overhead.
CHUNK, LARGEST_CHUNK = 4 << 20, 64 << 20
#: Bytes of text that one range of the hash space serves.
RANGE = 16 << 20
NULL_ID = -(1 << 63)
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads structured hashes over the whole range."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Powers:
    """Powers of an odd number and of its inverse modulo 2**64, for hashes of substrings by prefix sums."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.up) < n:
            k = len(self.up)
            self.up = np.concatenate((self.up, self.up * np.uint64(pow(self.base, k, 1 << 64))))
            self.down = np.concatenate((self.down, self.down * np.uint64(pow(self.inverse, k, 1 << 64))))
        return self.up[:n], self.down[:n]

    def sums(self, values: np.ndarray) -> np.ndarray:
        out = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * self.get(len(values))[0], out=out[1:])
        return out

    def spans(self, sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes of values[start:end]."""
        return (sums[ends] - sums[starts]) * self.get(len(sums))[1][starts]

    def windows(self, sums: np.ndarray, width: int) -> np.ndarray:
        n = len(sums) - width
        return (sums[width:] - sums[:n]) * self.get(len(sums))[1][:n] if n > 0 else np.zeros(0, np.uint64)


def sliding(values: np.ndarray, width: int, best) -> np.ndarray:
    """best (np.minimum or np.maximum) of every ``width`` values in a row."""
    out, reach = values, 1
    while reach < width:
        step = min(reach, width - reach)
        out = best(out[:-step], out[step:])
        reach += step
    return out


def minimizers(grams: np.ndarray, valid: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Of every window of ``width`` grams the least gram, and all grams that are the least of a valid window.

    ``valid`` says for each window whether it lies inside one document. Equal windows have equal minimizers. Least
    hashes are small, so both are mixed again to be even over the hash ranges.
    """
    if len(grams) < width:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    least = sliding(grams, width, np.minimum)
    held = np.concatenate((np.zeros(width - 1, np.uint64), np.where(valid, least, 0), np.zeros(width - 1, np.uint64)))
    return mixed(least), mixed(grams[(sliding(held, width, np.maximum) == grams) & (grams > 0)])


@dataclass
class Chunk:
    """Documents of a chunk in order of id (then text), their texts joined by ``gap``."""

    keys: np.ndarray
    missing: np.ndarray
    texts: list[bytes]

    @classmethod
    def of(cls, rows: pd.DataFrame) -> "Chunk":
        texts = [t.encode() for t in rows["text"]]
        keys = rows["key"].to_numpy()
        order = sorted(range(len(keys)), key=lambda i: (keys[i], texts[i]))
        return cls(keys[order], rows["missing"].to_numpy()[order], [texts[i] for i in order])


def chunked(docs: DataFrame, doc_id: str, text: str) -> tuple[DataFrame, int]:
    """(chunk, key, missing, text) and the number of hash ranges. A null id has the smallest key."""
    rows = docs.select(
        F.coalesce(F.col(doc_id).cast("bigint"), F.lit(NULL_ID)).alias("key"), F.col(doc_id).isNull().alias("missing"),
        text_or_empty(text).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    size = min(LARGEST_CHUNK, max(CHUNK, int(total ** 0.5) * 8))
    chunks = max(1, -(-total // size))
    return rows.withColumn("chunk", F.pmod(F.xxhash64("key"), F.lit(chunks)).cast("int")), power_of_two(
        total / RANGE, 8, 1 << 20)


PACKED = "chunk int, part int, data binary"


def part_of(hashes: np.ndarray, parts: int) -> np.ndarray:
    """The range of each hash; ``parts`` is a power of two."""
    return (hashes >> np.uint64(64 - parts.bit_length() + 1)).astype(np.int64) if parts > 1 else np.zeros(len(hashes), np.int64)


def pack(chunk: int, parts: int, hashes: np.ndarray, *more: np.ndarray) -> pd.DataFrame:
    """Rows for ascending hashes, one per part that gets any: count, hashes, then the other columns."""
    cuts = np.searchsorted(part_of(hashes, parts), np.arange(parts + 1))
    rows = [(chunk, p, b"".join([np.int64(b - a).tobytes(), hashes[a:b].tobytes(), *(m[a:b].tobytes() for m in more)]))
            for p, (a, b) in enumerate(zip(cuts, cuts[1:])) if b > a]
    return pd.DataFrame(rows, columns=["chunk", "part", "data"])


def unpack(data: bytes, types: list[str]) -> list[np.ndarray]:
    n = int(np.frombuffer(data, np.int64, 1)[0])
    out, at = [], 8
    for t in types:
        out.append(np.frombuffer(data, t, n, at))
        at += n * np.dtype(t).itemsize
    return out


def answered(questions: DataFrame, types: list[str], answer: Callable[..., list[np.ndarray]],
             second: tuple[int, list[str], Callable[..., list[np.ndarray]]] | None = None) -> DataFrame:
    """Answer the packed rows of each part. ``answer`` gets the columns of all rows of a part, each concatenated, and
    gives arrays of booleans; they return as packed bits for each row. ``second`` (first part, types, answer) is for
    questions of another kind, in the parts from there on."""
    def of_part(rows: pd.DataFrame) -> pd.DataFrame:
        kind = second[1:] if second and rows["part"].iloc[0] >= second[0] else (types, answer)
        columns = [unpack(d, kind[0]) for d in rows["data"]]
        sizes = [len(c[0]) for c in columns]
        bits = kind[1](*[np.concatenate(c) for c in zip(*columns)])
        ends = np.cumsum(sizes)
        data = [np.int64(n).tobytes() + b"".join(np.packbits(b[e - n:e]).tobytes() for b in bits)
                for n, e in zip(sizes, ends)]
        return pd.DataFrame({"chunk": rows["chunk"], "part": rows["part"], "data": data})

    return questions.groupBy("part").applyInPandas(of_part, PACKED)


def bits_of(rows: pd.DataFrame, number: int = 1) -> list[np.ndarray]:
    """The answers to a chunk in the order of its hashes."""
    out = [[] for _ in range(number)]
    for data in rows.sort_values("part")["data"]:
        n = int(np.frombuffer(data, np.int64, 1)[0])
        size = -(-n // 8)
        for i in range(number):
            out[i].append(np.unpackbits(np.frombuffer(data, np.uint8, size, 8 + i * size), count=n).astype(bool))
    return [np.concatenate(b) if b else np.zeros(0, bool) for b in out]


def unique_flagged(hashes: np.ndarray) -> np.ndarray:
    """Ascending distinct hashes whose lowest bit says whether the value (without that bit) occurs again."""
    found, counts = np.unique(hashes >> np.uint64(1), return_counts=True)
    return (found << np.uint64(1)) | (counts > 1).astype(np.uint64)


def repeated(hashes: np.ndarray) -> list[np.ndarray]:
    """Answer for flagged hashes: does the value occur twice anywhere?"""
    order = np.argsort(hashes, kind="stable")
    value = hashes[order] >> np.uint64(1)
    again = np.zeros(len(value), bool)
    if len(value):
        same = value[1:] == value[:-1]
        again[1:] |= same
        again[:-1] |= same
    out = np.empty(len(value), bool)
    out[order] = again | (hashes[order] & np.uint64(1)).astype(bool)
    return [out]


def known_repeats(found: np.ndarray, bits: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Whether each wanted hash is among the flagged ones that were answered with yes."""
    yes = found[bits] >> np.uint64(1)
    if not len(yes):
        return np.zeros(len(wanted), bool)
    value = wanted >> np.uint64(1)
    at = np.searchsorted(yes, value)
    return yes[np.minimum(at, len(yes) - 1)] == value
