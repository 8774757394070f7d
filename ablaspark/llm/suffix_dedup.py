"""Repeated byte strings from merged Burrows-Wheeler transforms.

Which bytes are covered by a string of ``length`` bytes that starts in an earlier document too? Equal
strings have equal minimizers (the least hash of their byte grams), so the text is cut into
regions of strings with one minimizer, and only regions whose minimizer repeats are looked at. Equal
regions are settled by their hash; every other distinct region goes, once, to the task of its
minimizer's hash range. Where the regions of one minimizer are too much text for a task (a passage that very many
documents share, each in a context of its own), their strings go singly to the ranges of their own hashes, so that equal
strings still meet but no others must. There strings whose hash no other document has go first, since equal
strings have equal hashes; what is left of the regions is cut into shards, each with its own transform, the
shards are merged by interleave refinement, rows whose common prefix reaches ``length`` form
repeated intervals, and the least document of an interval keeps its string.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bwt import merge, pairs, repeated_intervals, transform
from .common import stored
from .exchange import (PACKED, Chunk, Powers, answered, bits_of, chunked, known_repeats, mixed, pack, part_of, repeated, sliding,
                       unique_flagged)

LENGTH = 50
GRAM = 24
#: Documents of a chunk are scanned in blocks of about this many bytes.
BLOCK = 1 << 16
#: Region bytes per shard: sorting it packs two ranks and a place, of 21 bits each, into a word.
SHARD_BYTES = 1 << 21
#: Bytes of regions beyond which a minimizer is hot: its strings go singly, to HOT_SPREAD times as many ranges.
HOT_BYTES = 4 << 20
HOT_SPREAD = 8
_BYTES = Powers(0x5851F42D4C957F2D)


class Regions:
    """Regions of a chunk's documents: runs of strings that share their minimizer."""

    def __init__(self, chunk: Chunk, length: int, gram: int):
        self.chunk, self.length = chunk, length
        parts = []
        first, size = 0, 0
        for i, text in enumerate(chunk.texts):
            size += len(text)
            if size >= BLOCK or i == len(chunk.texts) - 1:
                parts.append(self._scan(first, i + 1, gram))
                first, size = i + 1, 0
        # minimizer, content hash, document, start in it, number of strings
        self.least, self.content, self.doc, self.start, self.strings = (
            np.concatenate(c) for c in zip(*parts)) if parts else (
                np.zeros(0, np.uint64), np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3)

    def _scan(self, a: int, b: int, gram: int):
        texts = self.chunk.texts[a:b]
        sizes = np.array([len(t) for t in texts], np.int64)
        data = np.frombuffer(b"".join(texts), np.uint8)
        ends = np.cumsum(sizes)
        sums = _BYTES.sums(data.astype(np.uint64) + np.uint64(1))
        n = max(0, len(data) - self.length + 1)
        valid = np.ones(n, bool)
        for end in ends[:-1].tolist():
            valid[max(0, end - self.length + 1):end] = False
        if not n:
            return *[np.zeros(0, np.uint64)] * 2, *[np.zeros(0, np.int64)] * 3
        least = sliding(mixed(_BYTES.windows(sums, gram)), self.length - gram + 1, np.minimum)
        edge = np.concatenate(([True], (least[1:] != least[:-1]) | (valid[1:] != valid[:-1]), [True]))
        edge[ends[ends < n]] = True  # a document of its own
        cuts = np.flatnonzero(edge)
        begin, number = cuts[:-1], np.diff(cuts)
        kept = valid[begin]
        begin, number = begin[kept], number[kept]
        stop = begin + number + self.length - 1
        content = mixed(_BYTES.spans(sums, begin, stop) + mixed(number.astype(np.uint64)))
        doc = np.searchsorted(ends, begin, side="right")
        # least hashes are small: mixed again, they are even over the hash ranges
        return mixed(least[begin]), content, doc + a, begin - (ends - sizes)[doc], number

    def asked(self) -> np.ndarray:
        """The chunk's minimizers, flagged if several of its regions have them. A string of another document lies in
        another region, so a minimizer with one region anywhere has no repeats."""
        return unique_flagged(self.least)

    def shared(self, bits: np.ndarray) -> "Shared":
        return Shared(self, np.flatnonzero(known_repeats(self.asked(), bits, self.least)))


class Shared:
    """The distinct regions with a repeated minimizer, by minimizer, each with its first document in the chunk."""

    def __init__(self, regions: Regions, at: np.ndarray):
        self.regions, self.at = regions, at
        order = at[np.lexsort((regions.content[at], regions.least[at]))]  # stable, and regions are found in order of document and start
        head = np.concatenate(([True], (regions.content[order][1:] != regions.content[order][:-1])
                               | (regions.least[order][1:] != regions.least[order][:-1]))) if len(order) else np.zeros(0, bool)
        self.order, self.group = order, np.cumsum(head) - 1
        self.first = order[head]
        self.least, self.content = regions.least[self.first], regions.content[self.first]
        self.keys = regions.chunk.keys[regions.doc[self.first]] if len(order) else np.zeros(0, np.int64)
        self.by_content = np.argsort(self.content, kind="stable")
        new = np.concatenate(([True], self.least[1:] != self.least[:-1])) if len(order) else np.zeros(0, bool)
        self.heads, self.minimizer = np.flatnonzero(new), np.cumsum(new) - 1

    def questions(self, chunk: int, parts: int) -> pd.DataFrame:
        """By content: is this the first document? By minimizer, in parts of their own: are there several contents, and how
        many bytes? A chunk asks once for each, so no content and no minimizer is hot here."""
        size = self.regions.strings[self.first] + self.regions.length - 1
        kinds = np.diff(np.append(self.heads, len(self.first)))
        by_content = pack(chunk, parts, self.content[self.by_content], self.keys[self.by_content])
        by_least = pack(chunk, parts, self.least[self.heads], np.where(kinds > 1, SEVERAL, self.content[self.heads]),
                        np.add.reduceat(size, self.heads) if len(size) else size)
        return pd.concat([by_content, by_least.assign(part=by_least["part"] + parts)])

    def answers(self, bits: pd.DataFrame, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each distinct region: is it the first document's, has its minimizer several contents, is it hot?"""
        owner = np.empty(len(self.first), bool)
        owner[self.by_content] = bits_of(bits[bits["part"] < parts])[0]
        several, hot = bits_of(bits[bits["part"] >= parts], 2)
        return owner, several[self.minimizer], hot[self.minimizer]

    def texts(self, chosen: np.ndarray) -> list[bytes]:
        r = self.regions
        return [r.chunk.texts[d][s:s + n + r.length - 1] for d, s, n in zip(
            r.doc[self.first[chosen]].tolist(), r.start[self.first[chosen]].tolist(), r.strings[self.first[chosen]].tolist())]


class Singles:
    """The distinct strings of chosen regions, by hash, each with its least document in the chunk."""

    def __init__(self, shared: Shared, chosen: np.ndarray):
        length = shared.regions.length
        texts = shared.texts(chosen)
        number = shared.regions.strings[shared.first[chosen]]
        data = b"".join(texts)
        self.offset = np.cumsum(number) - number
        own = np.repeat(np.arange(len(number)), number)
        at = np.arange(len(own)) + own * (length - 1)  # a region has length - 1 more bytes than strings
        sums = _BYTES.sums(np.frombuffer(data, np.uint8).astype(np.uint64) + np.uint64(1))
        hashes, keys = mixed(_BYTES.spans(sums, at, at + length)), shared.keys[chosen][own]
        order = np.lexsort((keys, hashes))
        new = np.concatenate(([True], hashes[order][1:] != hashes[order][:-1])) if len(order) else np.zeros(0, bool)
        self.which = np.empty(len(order), np.int64)
        self.which[order] = np.cumsum(new) - 1
        first = order[new]
        self.hashes, self.keys = hashes[first], keys[first]
        self.texts = [data[a:a + length] for a in at[first].tolist()]
        self.later = keys > self.keys[self.which]

    def hits(self, verdicts: np.ndarray) -> np.ndarray:
        """For each string of the regions: does it start in an earlier document, of this chunk or of another?"""
        return verdicts[self.which] | self.later


def _ask_minimizers(parts: int, length: int, gram: int):
    def ask(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return pack(int(key[0]), parts, Regions(Chunk.of(rows), length, gram).asked())

    return ask


def _ask_regions(parts: int, length: int, gram: int):
    def ask(key: tuple, rows: pd.DataFrame, bits: pd.DataFrame) -> pd.DataFrame:
        return Regions(Chunk.of(rows), length, gram).shared(bits_of(bits)[0]).questions(int(key[0]), parts)

    return ask


#: In place of a content: a chunk has several contents of a minimizer.
SEVERAL = np.uint64(0)


def _first_documents(content: np.ndarray, keys: np.ndarray) -> list[np.ndarray]:
    """Is it the content's first document?"""
    order = np.lexsort((keys, content))
    first = np.empty(len(order), bool)
    first[order] = np.concatenate(([True], content[order][1:] != content[order][:-1]))
    return [first]


def _judged(hot_bytes: int):
    def judged(least: np.ndarray, content: np.ndarray, size: np.ndarray) -> list[np.ndarray]:
        """Has the minimizer several contents, and more bytes of them than one task should get?"""
        order = np.argsort(least, kind="stable")
        heads = np.flatnonzero(np.concatenate(([True], least[order][1:] != least[order][:-1])))
        low, high = np.minimum.reduceat(content[order], heads), np.maximum.reduceat(content[order], heads)
        several = (low == SEVERAL) | (low != high)
        hot = several & (np.add.reduceat(size[order], heads) > hot_bytes)
        group = np.empty(len(order), np.int64)
        group[order] = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, len(order))))
        return [several[group], hot[group]]

    return judged


def _blobs(chunk: int, parts: int, first_part: int, hashes: np.ndarray, keys: np.ndarray, texts: list[bytes]) -> list[tuple]:
    """Rows for texts in ascending order of their hashes: number, documents, sizes and texts of a part."""
    sizes = np.array([len(t) for t in texts], np.int64)
    cuts = np.searchsorted(part_of(hashes, parts), np.arange(parts + 1))
    return [(chunk, first_part + p, np.int64(b - a).tobytes() + keys[a:b].tobytes() + sizes[a:b].tobytes() + b"".join(texts[a:b]))
            for p, (a, b) in enumerate(zip(cuts.tolist(), cuts[1:].tolist())) if b > a]


def _send_regions(parts: int, length: int, gram: int):
    def send(key: tuple, rows: pd.DataFrame, bits: pd.DataFrame) -> pd.DataFrame:
        shared = Regions(Chunk.of(rows), length, gram).shared(bits_of(bits[bits["step"] == 0])[0])
        owner, several, hot = shared.answers(bits[bits["step"] == 1], parts)
        chosen = np.flatnonzero(owner & several & ~hot)
        singles = Singles(shared, np.flatnonzero(owner & several & hot))
        out = _blobs(int(key[0]), parts, 0, shared.least[chosen], shared.keys[chosen], shared.texts(chosen))
        out += _blobs(int(key[0]), parts * HOT_SPREAD, parts, singles.hashes, singles.keys, singles.texts)
        return pd.DataFrame(out, columns=["chunk", "part", "data"])

    return send


class _Shards:
    """Strings of a part: circular strings with the end symbol, and the document of each."""

    def __init__(self, keys: np.ndarray, sizes: np.ndarray, symbols: np.ndarray):
        self.keys, self.sizes, self.symbols = keys, sizes, symbols
        self.begin = np.cumsum(sizes + 1) - (sizes + 1)

    @classmethod
    def of(cls, blobs: list[bytes]) -> tuple["_Shards", list[int]]:
        """The strings, and how many each blob has."""
        keys, sizes, texts, counts = [], [], [], []
        for blob in blobs:
            n = int(np.frombuffer(blob, np.int64, 1)[0])
            counts.append(n)
            keys.append(np.frombuffer(blob, np.int64, n, 8))
            sizes.append(np.frombuffer(blob, np.int64, n, 8 + 8 * n))
            texts.append(np.frombuffer(blob, np.uint8, int(sizes[-1].sum()), 8 + 16 * n))
        size, text = np.concatenate(sizes), np.concatenate(texts)
        symbols = np.zeros(len(text) + len(size), np.uint8)
        # UTF-8 has no byte above 0xF4, so symbols fit
        symbols[np.arange(len(text)) + np.repeat(np.arange(len(size)), size)] = text + np.uint8(1)
        return cls(np.concatenate(keys), size, symbols), counts

    def windows(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Where strings of ``length`` symbols start, and in which of the strings."""
        number = self.sizes - (length - 1)
        own = np.repeat(np.arange(len(number)), number)
        return np.arange(len(own)) + np.repeat(self.begin - (np.cumsum(number) - number), number), own

    def shared(self, at: np.ndarray, own: np.ndarray, length: int) -> np.ndarray:
        """Numbers of the windows whose hash another document has too; all others have no equal elsewhere."""
        hashes = mixed(_BYTES.spans(_BYTES.sums(self.symbols.astype(np.uint64) + np.uint64(1)), at, at + length))
        place = max(1, (len(at) - 1).bit_length())  # the low bits make room for the number: more may seem equal, none less
        words = (hashes >> np.uint64(place) << np.uint64(place)) | np.arange(len(at), dtype=np.uint64)
        words.sort()
        order, value = (words & np.uint64((1 << place) - 1)).astype(np.int64), words >> np.uint64(place)
        heads = np.flatnonzero(np.concatenate(([True], value[1:] != value[:-1])))
        keys = self.keys[own[order]]
        several = np.minimum.reduceat(keys, heads) < np.maximum.reduceat(keys, heads)
        return np.sort(order[np.repeat(several, np.diff(np.append(heads, len(order))))])

    def runs(self, at: np.ndarray, own: np.ndarray, length: int) -> tuple["_Shards", np.ndarray]:
        """Strings of their own for runs of chosen windows (ascending), and where each of those starts now."""
        first = np.concatenate(([True], (at[1:] != at[:-1] + 1) | (own[1:] != own[:-1])))
        heads = np.flatnonzero(first)
        sizes = np.diff(np.append(heads, len(at))) + length - 1
        out = _Shards(self.keys[own[heads]], sizes, np.zeros(int(sizes.sum()) + len(sizes), np.uint8))
        run = np.repeat(np.arange(len(sizes)), sizes)
        place = np.arange(len(run)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        out.symbols[out.begin[run] + place] = self.symbols[at[heads][run] + place]
        return out, at + (out.begin - at[heads])[np.cumsum(first) - 1]


def _least_documents(strings: _Shards, length: int) -> np.ndarray:
    """For each position of the strings the least document with the same ``length`` symbols there."""
    n = len(strings.symbols)
    # shards: strings one after another, about SHARD_BYTES each
    total = np.cumsum(strings.sizes + 1)
    number = min(1 << 15, max(1, -(-n // SHARD_BYTES)))
    edges = np.unique(np.searchsorted(total, np.linspace(0, n, number + 1)[1:], side="left") + 1)
    rows, transforms = [], []
    a = 0
    for b in np.minimum(edges, len(total)).tolist():
        if b <= a:
            continue
        low = int(strings.begin[a])
        high = int(strings.begin[b - 1] + strings.sizes[b - 1] + 1)
        r, t = transform(strings.symbols[low:high], strings.begin[a:b] - low, strings.sizes[a:b] + 1, length)
        rows.append(r + low)
        transforms.append(pairs(t) if length % 2 == 0 else t)
        a = b
    shard, common = merge(transforms, length, 2 if length % 2 == 0 else 1)
    interval = repeated_intervals(common, length)
    merged = np.empty(n, np.int64)
    merged[np.argsort(shard, kind="stable")] = np.concatenate(rows)
    owner = np.repeat(strings.keys, strings.sizes + 1)[merged]
    least = np.minimum.reduceat(owner, np.flatnonzero(np.concatenate(([True], interval[1:] != interval[:-1]))))
    out = np.empty(n, np.int64)
    out[merged] = least[interval - interval[0]]
    return out


def _judge_regions(length: int):
    def judge(rows: pd.DataFrame) -> pd.DataFrame:
        strings, counts = _Shards.of(list(rows["data"]))
        at, own = strings.windows(length)
        earlier = np.zeros(len(at), bool)
        found = strings.shared(at, own, length)
        if len(found):
            left, where = strings.runs(at[found], own[found], length)
            earlier[found] = _least_documents(left, length)[where] < strings.keys[own[found]]
        data, used, done = [], 0, np.cumsum(strings.sizes - (length - 1))
        for n in counts:
            a, b = (int(done[used - 1]) if used else 0), int(done[used + n - 1])
            data.append(np.int64(b - a).tobytes() + np.packbits(earlier[a:b]).tobytes())
            used += n
        return pd.DataFrame({"chunk": rows["chunk"], "part": rows["part"], "data": data})

    return judge


RESULT = ("key bigint, missing boolean, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")


def _apply(parts: int, length: int, gram: int):
    def last(key: tuple, rows: pd.DataFrame, bits: pd.DataFrame) -> pd.DataFrame:
        regions = Regions(Chunk.of(rows), length, gram)
        shared = regions.shared(bits_of(bits[bits["step"] == 0])[0])
        owner, several, hot = shared.answers(bits[bits["step"] == 1], parts)
        verdicts = bits_of(bits[bits["step"] == 2])[0]
        # regions that are not their first document's go whole
        doc, start, strings = regions.doc[shared.order], regions.start[shared.order], regions.strings[shared.order]
        same = regions.chunk.keys[doc] == shared.keys[shared.group] if len(doc) else np.zeros(0, bool)
        whole = ~(owner[shared.group] & same)
        spans = [np.stack([doc[whole], start[whole], start[whole] + strings[whole] + length - 1])]
        # of the others, the strings that an earlier document has; repeats in one document are judged alike
        chosen, single = np.flatnonzero(owner & several & ~hot), np.flatnonzero(owner & several & hot)
        number = regions.strings[shared.first[chosen]]
        offset, regular = np.zeros(len(owner), np.int64), int(number.sum())
        offset[chosen] = np.cumsum(number) - number
        singles = Singles(shared, single)
        offset[single] = regular + singles.offset
        verdicts = np.concatenate((verdicts[:regular], singles.hits(verdicts[regular:])))
        part = np.flatnonzero(~whole & (owner & several)[shared.group])
        size = strings[part]
        own = np.repeat(part, size)
        step = np.arange(len(own)) - np.repeat(np.cumsum(size) - size, size)
        hit = verdicts[offset[shared.group[own]] + step] if len(own) else np.zeros(0, bool)
        own, step = own[hit], step[hit]
        spans.append(np.stack([doc[own], start[own] + step, start[own] + step + length]))
        at_doc, low, high = np.concatenate(spans, axis=1)
        order = np.argsort(at_doc, kind="stable")
        at_doc, low, high = at_doc[order], low[order], high[order]
        cuts = np.searchsorted(at_doc, np.arange(len(regions.chunk.texts) + 1))
        out = []
        for i, (text, a, b) in enumerate(zip(regions.chunk.texts, cuts.tolist(), cuts[1:].tolist())):
            removed, runs, kept = 0, 0, text
            if b > a:
                steps = np.zeros(len(text) + 1, np.int64)
                np.add.at(steps, low[a:b], 1)
                np.add.at(steps, high[a:b], -1)
                gone = np.cumsum(steps[:-1]) > 0
                removed, runs = int(gone.sum()), int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
            out.append((regions.chunk.keys[i], regions.chunk.missing[i], len(text), removed, runs,
                        hashlib.sha256(kept).hexdigest()))
        return pd.DataFrame(out, columns=[c.split(" ")[0] for c in RESULT.split(", ")])

    return last


def repeated_bytes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH,
                   gram: int = GRAM, hot_bytes: int = HOT_BYTES) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256 (of the bytes that stay).

    A byte goes if a string of ``length`` bytes that covers it also starts in a document of smaller id. A null text is
    empty, a null id the smallest. Rows that share an id count as one document, so none of them removes
    from another. Shorter texts lose nothing. Other columns are ignored; an empty table gives no rows. ``hot_bytes``
    changes where strings are compared, not the result.
    """
    texts, parts = chunked(docs, doc_id, text)
    by_chunk = texts.groupBy("chunk")

    def step(rows: DataFrame, number: int) -> DataFrame:
        return rows.withColumn("step", F.lit(number))

    first = step(stored(answered(by_chunk.applyInPandas(_ask_minimizers(parts, length, gram), PACKED), ["u8"], repeated),
                        "minimizer-bits"), 0)
    second = step(stored(answered(by_chunk.cogroup(first.groupBy("chunk")).applyInPandas(
        _ask_regions(parts, length, gram), PACKED), ["u8", "i8"], _first_documents,
        (parts, ["u8", "u8", "i8"], _judged(hot_bytes))), "region-bits"), 1)
    both = first.unionByName(second)
    sent = by_chunk.cogroup(both.groupBy("chunk")).applyInPandas(_send_regions(parts, length, gram), PACKED)
    third = step(stored(sent.groupBy("part").applyInPandas(_judge_regions(length), PACKED), "interval-bits"), 2)
    return by_chunk.cogroup(both.unionByName(third).groupBy("chunk")).applyInPandas(_apply(parts, length, gram), RESULT).select(
        F.when(~F.col("missing"), F.col("key")).alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")
