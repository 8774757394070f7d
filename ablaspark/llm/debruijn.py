"""Repeated spans of words by compaction of a de Bruijn graph of token k-mers.

A window of WINDOW words is an edge from its first WINDOW - 1 words to its last. Edges can only repeat
if their minimizer (the least hash among their word 8-grams) does, so first the minimizers are counted,
then only the edges around repeated ones are compared, and each repeated edge learns the coordinate of
its first place in the corpus, its source (see exchange).

Sources that follow each other are a path as long as the node between them has one way in and one way out
in the whole graph; paths that meet in such a node are joined through Spark. Places that are not sources
follow a path's coordinates for a span. Before a span may remove anything its words are compared (as SHA-256) with the
words at its source, where the path must cover it; spans that differ there, since two windows share a
hash, are judged by their windows' own digests.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored
from .components import components
from .exchange import (PACKED, Chunk, Powers, answered, bits_of, chunked, known_repeats, minimizers, mixed, pack, repeated,
                       unique_flagged, unpack)

WINDOW = 20
GRAM = 8
#: A coordinate is the chunk, then the place of a word among the words of the chunk, in this many bits.
PLACE_BITS = 40
_SLICE = 1 << 20
_BLANK = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_BYTES, _WORDS = Powers(0x5851F42D4C957F2D), Powers(0x14057B7EF767814F)


def word_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of every word of the bytes."""
    word = np.concatenate(([False], ~_BLANK[data], [False]))
    edges = np.flatnonzero(word[1:] != word[:-1])
    starts, ends = edges[::2], edges[1::2]
    out = np.empty(len(starts), np.uint64)
    a = 0
    while a < len(starts):  # in slices, so that long texts need no more memory for sums
        b = max(a + 1, int(np.searchsorted(ends, starts[a] + _SLICE, side="right")))
        low = starts[a]
        sums = _BYTES.sums(data[low:ends[b - 1]].astype(np.uint64) + np.uint64(1))
        out[a:b] = mixed(_BYTES.spans(sums, starts[a:b] - low, ends[a:b] - low) + (ends[a:b] - starts[a:b]).astype(np.uint64))
        a = b
    return out


class Windows:
    """Edges of the documents of a chunk, in document order."""

    def __init__(self, chunk: Chunk, window: int, gram: int, edge_bits: int):
        self.chunk, self.window = chunk, window
        data = np.frombuffer(b"\n".join(chunk.texts), np.uint8)
        hashes = word_hashes(data)
        words = np.array([len(t.split()) for t in chunk.texts], np.int64)
        self.sums = _WORDS.sums(hashes)
        owner = np.repeat(np.arange(len(words)), words)
        # lower bits are masked, so that edges stay even over the hash ranges
        self.edges = mixed(_WORDS.windows(self.sums, window)) & ~np.uint64((1 << (64 - edge_bits)) - 1)
        self.valid = owner[:len(self.edges)] == owner[len(owner) - len(self.edges):]
        self.owner = owner
        self.least, self.anchors = minimizers(mixed(_WORDS.windows(self.sums, gram)), self.valid, window - gram + 1)

    def nodes(self) -> np.ndarray:
        """The node before each edge, and the one after the last."""
        return mixed(_WORDS.windows(self.sums, self.window - 1))


def _texts_at(chunk: Chunk, begin: np.ndarray, size: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """(index, words joined by a space) of spans of a chunk's words; a text is split only if a span lies in it."""
    order = np.argsort(begin, kind="stable")
    first, at = 0, 0
    for text in chunk.texts:
        if at == len(order):
            return
        words = None
        n = len(text.split())
        while at < len(order) and begin[order[at]] < first + n:
            words = text.split() if words is None else words
            low = int(begin[order[at]]) - first
            yield int(order[at]), b" ".join(words[low:low + int(size[order[at]])])
            at += 1
        first += n


def _digests(chunk: Chunk, begin: np.ndarray, size: np.ndarray) -> list[bytes]:
    out = [b""] * len(begin)
    for i, text in _texts_at(chunk, begin, size):
        out[i] = hashlib.sha256(text).digest()
    return out


def _ask_minimizers(parts: int, shape: tuple[int, int, int]):
    def ask(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return pack(int(key[0]), parts, unique_flagged(Windows(Chunk.of(rows), *shape).anchors))

    return ask


def _candidates(found: Windows, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct edges (ascending) around repeated minimizers, first places in the chunk, and all places by edge."""
    here = np.flatnonzero(found.valid & known_repeats(unique_flagged(found.anchors), bits, found.least)) \
        if len(found.valid) else np.zeros(0, np.int64)
    edges, first, inverse = np.unique(found.edges[here], return_index=True, return_inverse=True)
    return edges, here[first], np.stack([here, inverse])


def _ask_edges(parts: int, shape: tuple[int, int, int]):
    def ask(key: tuple, rows: pd.DataFrame, bits: pd.DataFrame) -> pd.DataFrame:
        found = Windows(Chunk.of(rows), *shape)
        edges, first, places = _candidates(found, bits_of(bits)[0])
        several = np.bincount(places[1], minlength=len(edges)) > 1
        return pack(int(key[0]), parts, edges, found.chunk.keys[found.owner[first]], several.astype(np.uint8),
                    (int(key[0]) << PLACE_BITS) + first)

    return ask


def _sources(rows: pd.DataFrame) -> pd.DataFrame:
    """For the edges of a part: is this the first chunk, does the edge repeat at all, and where is it first (others only)?"""
    columns = [unpack(d, ["u8", "i8", "u1", "i8"]) for d in rows["data"]]
    sizes = [len(c[0]) for c in columns]
    edges, keys, several, places = (np.concatenate(c) for c in zip(*columns))
    order = np.lexsort((keys, edges))
    head = np.concatenate(([True], edges[order][1:] != edges[order][:-1]))
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(head) - 1
    first = np.zeros(len(order), bool)
    first[order[head]] = True
    again = ((np.bincount(group) > 1) | (np.bincount(group, weights=several) > 0))[group]
    source = places[order[head]][group]
    data = []
    for n, end in zip(sizes, np.cumsum(sizes)):
        f, a = first[end - n:end], again[end - n:end]
        data.append(np.int64(n).tobytes() + np.packbits(f).tobytes() + np.packbits(a).tobytes()
                    + source[end - n:end][~f].tobytes())
    return pd.DataFrame({"chunk": rows["chunk"], "part": rows["part"], "data": data})


class Repeats:
    """Places of repeated edges in a chunk, ascending, and the coordinate of each one's source."""

    def __init__(self, number: int, found: Windows, minimizer_bits: pd.DataFrame, answers: pd.DataFrame):
        edges, first_here, places = _candidates(found, bits_of(minimizer_bits)[0])
        first, again = bits_of(answers, 2)
        own = number << PLACE_BITS
        source = own + first_here
        elsewhere = [np.frombuffer(d, np.int64, offset=8 + 2 * -(-int(np.frombuffer(d, np.int64, 1)[0]) // 8))
                     for d in answers.sort_values("part")["data"]]
        if elsewhere:
            source[~first] = np.concatenate(elsewhere)
        at = again[places[1]] if len(again) else np.zeros(0, bool)
        self.places, self.source = places[0][at], source[places[1][at]]
        here = self.source == own + self.places
        self.first = self.places[here]
        self.later, self.later_source = self.places[~here], self.source[~here]

    def nodes(self, found: Windows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct nodes of the sources (ascending), ways out and ways in (2: several)."""
        nodes = found.nodes()
        k = len(self.first)
        distinct, inverse = np.unique(np.concatenate((nodes[self.first], nodes[self.first + 1])), return_inverse=True)
        ways = [np.minimum(np.bincount(i, minlength=len(distinct)), 2).astype(np.uint8) for i in (inverse[:k], inverse[k:])]
        return distinct, *ways


def _ask_nodes(parts: int, shape: tuple[int, int, int]):
    def ask(key: tuple, rows: pd.DataFrame, bits: pd.DataFrame) -> pd.DataFrame:
        found = Windows(Chunk.of(rows), *shape)
        repeats = Repeats(int(key[0]), found, bits[bits["step"] == 0], bits[bits["step"] == 1])
        return pack(int(key[0]), parts, *repeats.nodes(found))

    return ask


def _unbranched(nodes: np.ndarray, out: np.ndarray, into: np.ndarray) -> list[np.ndarray]:
    """Has the node one way in and one way out at most?"""
    _, group = np.unique(nodes, return_inverse=True)
    return [((np.bincount(group, weights=out) <= 1) & (np.bincount(group, weights=into) <= 1))[group]]


GRAPH = ("kind string, chunk int, place bigint, edges bigint, key bigint, missing boolean, node_in bigint, node_out bigint, "
         "source_chunk int, source_place bigint, digest binary")


def _runs(new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and size of runs whose first members are marked."""
    begin = np.flatnonzero(new)
    return begin, np.diff(np.concatenate((begin, [len(new)])))


def _graph(shape: tuple[int, int, int]):
    window = shape[0]

    def emit(key: tuple, rows: pd.DataFrame, bits: pd.DataFrame) -> pd.DataFrame:
        number = int(key[0])
        found = Windows(Chunk.of(rows), *shape)
        repeats = Repeats(number, found, bits[bits["step"] == 0], bits[bits["step"] == 1])
        distinct, *_ = repeats.nodes(found)
        simple = bits_of(bits[bits["step"] == 2])[0]
        out = []
        at = repeats.first
        if len(at):
            nodes = found.nodes()
            passable = simple[np.searchsorted(distinct, nodes[at])]
            new = np.concatenate(([True], (at[1:] != at[:-1] + 1) | (found.owner[at[1:]] != found.owner[at[:-1]]))) | ~passable
            signed = nodes.view(np.int64)
            for b, n in zip(*(a.tolist() for a in _runs(new))):
                place = int(at[b])
                i = found.owner[place]
                out.append(("path", number, place, n, found.chunk.keys[i], found.chunk.missing[i], signed[place],
                            signed[place + n], 0, 0, None))
        at, source = repeats.later, repeats.later_source
        if len(at):
            new = np.concatenate(([True], (at[1:] != at[:-1] + 1) | (source[1:] != source[:-1] + 1)
                                  | (found.owner[at[1:]] != found.owner[at[:-1]])))
            begin, size = _runs(new)
            for place, n, s, d in zip(at[begin].tolist(), size.tolist(), source[begin].tolist(),
                                      _digests(found.chunk, at[begin], size + window - 1)):
                out.append(("span", number, place, n, 0, False, 0, 0, s >> PLACE_BITS, s & ((1 << PLACE_BITS) - 1), d))
        return pd.DataFrame(out, columns=[c.split(" ")[0] for c in GRAPH.split(", ")])

    return emit


def compact(paths: DataFrame) -> DataFrame:
    """Join paths (path, edges, node_in, node_out) that meet in a node with one way in and one out.

    Paths must end at every node that branches, so that ends alone tell its ways.
    Returns path, whole (id of the joined path) and edges (of the joined path).
    """
    ends = paths.groupBy(F.col("node_out").alias("node")).agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("before"))
    starts = paths.groupBy(F.col("node_in").alias("node")).agg(F.count(F.lit(1)).alias("m"), F.min("path").alias("after"))
    links = ends.filter("n = 1").join(starts.filter("m = 1"), "node").select(
        F.col("before").alias("a"), F.col("after").alias("b"))
    whole = paths.join(components(links).withColumnRenamed("node", "path"), "path", "left").withColumn(
        "whole", F.coalesce("root", "path"))
    sizes = whole.groupBy("whole").agg(F.sum("edges").alias("all_edges"))
    return whole.join(sizes, "whole").select("path", "whole", F.col("all_edges").alias("edges"))


CHECKED = "source_chunk int, source_place bigint, edges bigint, digest binary, same boolean"


def _verify(window: int):
    def verify(key: tuple, rows: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        """Are the words at the source those of the span, and do paths cover them?"""
        paths = asked[asked["kind"] == "path"].sort_values("place")
        spans = asked[asked["kind"] == "span"]
        begin, size = spans["place"].to_numpy(np.int64), spans["edges"].to_numpy(np.int64)
        low, n = paths["place"].to_numpy(np.int64), paths["edges"].to_numpy(np.int64)
        total = np.concatenate(([0], np.cumsum(n)))

        def covered(place: np.ndarray) -> np.ndarray:
            i = np.searchsorted(low, place, side="right") - 1
            inside = np.minimum(place - low[np.maximum(i, 0)], n[np.maximum(i, 0)]) if len(low) else 0
            return np.where(i >= 0, total[np.maximum(i, 0)] + inside, 0)

        on_path = covered(begin + size) - covered(begin) == size
        words = _digests(Chunk.of(rows), begin, size + window - 1)
        same = [a == bytes(b) for a, b in zip(words, spans["digest"])]
        return pd.DataFrame({"source_chunk": int(key[0]), "source_place": begin, "edges": size, "digest": spans["digest"].to_numpy(),
                             "same": np.array(same, bool) & on_path})

    return verify


WINDOWS = "chunk int, place bigint, key bigint, later boolean, digest binary"


def _window_digests(window: int):
    def emit(key: tuple, rows: pd.DataFrame, spans: pd.DataFrame) -> pd.DataFrame:
        chunk = Chunk.of(rows)
        size = spans["edges"].to_numpy(np.int64)
        place = np.repeat(spans["place"].to_numpy(np.int64), size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        ends = np.cumsum([len(t.split()) for t in chunk.texts])
        return pd.DataFrame({
            "chunk": int(key[0]), "place": place, "key": chunk.keys[np.searchsorted(ends, place, side="right")],
            "later": np.repeat(spans["later"].to_numpy(bool), size),
            "digest": _digests(chunk, place, np.full(len(place), window))})

    return emit


def _judged_by_windows(texts: DataFrame, spans: DataFrame, wrong: DataFrame, window: int) -> DataFrame:
    """(chunk, place, edges = 1) of the windows of spans unlike their sources that start earlier elsewhere.

    All places of a hash that are unlike its source are in such spans, so a window's first place is among them or
    is its source.
    """
    asked = spans.join(wrong, ["source_chunk", "source_place", "edges", "digest"], "left_semi").select(
        "chunk", "place", "edges", F.lit(True).alias("later")).unionByName(wrong.select(
            F.col("source_chunk").alias("chunk"), F.col("source_place").alias("place"), "edges", F.lit(False).alias("later")))
    windows = stored(texts.groupBy("chunk").cogroup(asked.groupBy("chunk")).applyInPandas(
        _window_digests(window), WINDOWS), "windows")
    first = windows.groupBy("digest").agg(F.min(F.struct("key", "place")).alias("first"))
    return windows.filter("later").join(first, "digest").filter("struct(key, place) > first").select(
        "chunk", "place", F.lit(1).cast("bigint").alias("edges"))


RESULT = "key bigint, missing boolean, words bigint, removed bigint, kept_sha256 string"


def _remove(window: int):
    def remove(key: tuple, rows: pd.DataFrame, spans: pd.DataFrame) -> pd.DataFrame:
        chunk = Chunk.of(rows)
        begin = np.sort(spans["place"].to_numpy(np.int64))
        end = np.sort((spans["place"] + spans["edges"] + window - 1).to_numpy(np.int64))
        out, first = [], 0
        for i, text in enumerate(chunk.texts):
            words = text.split()
            n = len(words)
            a, b = np.searchsorted(begin, [first, first + n])
            lost = np.zeros(0, bool)
            if b > a:  # a span lies in one document, so its ends do too
                steps = np.zeros(n + 1, np.int64)
                np.add.at(steps, begin[a:b] - first, 1)
                np.add.at(steps, end[a:b] - first, -1)
                lost = np.cumsum(steps[:-1]) > 0
                words = [w for w, g in zip(words, lost.tolist()) if not g]
            out.append((chunk.keys[i], chunk.missing[i], n, int(lost.sum()), hashlib.sha256(b" ".join(words)).hexdigest()))
            first += n
        return pd.DataFrame(out, columns=[c.split(" ")[0] for c in RESULT.split(", ")])

    return remove


def repeated_words(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW,
                   gram: int = GRAM, edge_bits: int = 64) -> tuple[DataFrame, DataFrame]:
    """Documents (doc_id, n_words, n_removed, kept_sha256, longest_source) and source paths (doc_id, chunk, place, edges).

    A word goes if a window that covers it also starts earlier: in a document of smaller id, or before in the same one.
    longest_source is the length in words of the longest joined path with a part whose first place is in the
    document (0: none). A null text has no words; a null id is the smallest. Rows that share an id come in the order
    of their texts. Documents shorter than a window lose nothing. Other columns are ignored; an
    empty table gives no rows. ``edge_bits`` are the bits of an edge's hash; fewer cost time, the result is the same.
    """
    texts, parts = chunked(docs, doc_id, text)
    by_chunk = texts.groupBy("chunk")
    shape = (window, gram, edge_bits)

    def step(rows: DataFrame, number: int) -> DataFrame:
        return rows.withColumn("step", F.lit(number))

    def with_answers(function, answers: DataFrame, schema: str) -> DataFrame:
        return by_chunk.cogroup(answers.groupBy("chunk")).applyInPandas(function, schema)

    known = step(stored(answered(by_chunk.applyInPandas(_ask_minimizers(parts, shape), PACKED), ["u8"], repeated),
                        "minimizer-bits"), 0)
    known = known.unionByName(step(stored(with_answers(_ask_edges(parts, shape), known, PACKED).groupBy("part").applyInPandas(
        _sources, PACKED), "edge-sources"), 1))
    known = known.unionByName(step(stored(answered(with_answers(_ask_nodes(parts, shape), known, PACKED), ["u8", "u1", "u1"],
                                                   _unbranched), "node-bits"), 2))
    graph = stored(with_answers(_graph(shape), known, GRAPH), "graph")
    paths, spans = graph.filter("kind = 'path'"), graph.filter("kind = 'span'")
    named = paths.select("chunk", "place", "edges", "key", "missing", "node_in", "node_out",
                         (F.col("chunk").cast("bigint") * (1 << PLACE_BITS) + F.col("place")).alias("path"))
    whole = stored(named.select("path", "chunk", "place", "key", F.col("edges").alias("part_edges")).join(
        compact(named.select("path", "edges", "node_in", "node_out")), "path"), "paths")

    # equal spans of a source are compared with it once
    asked = spans.select("kind", F.col("source_chunk").alias("chunk"), F.col("source_place").alias("place"), "edges",
                         "digest").distinct().unionByName(
        whole.select(F.lit("path").alias("kind"), "chunk", "place", F.col("part_edges").alias("edges"),
                     F.lit(None).cast("binary").alias("digest")))
    wrong = stored(with_answers(_verify(window), asked, CHECKED).filter("not same").drop("same"), "unlike-sources")
    gone = spans.select("chunk", "place", "edges")
    if not wrong.isEmpty():
        gone = spans.join(wrong, ["source_chunk", "source_place", "edges", "digest"], "left_anti").select(
            "chunk", "place", "edges").unionByName(_judged_by_windows(texts, spans, wrong, window))

    longest = whole.groupBy("key").agg((F.max("edges") + window - 1).alias("longest_source"))
    documents = with_answers(_remove(window), gone, RESULT).join(longest, "key", "left").select(
        F.when(~F.col("missing"), F.col("key")).alias("doc_id"), F.col("words").alias("n_words"),
        F.col("removed").alias("n_removed"), "kept_sha256",
        F.coalesce("longest_source", F.lit(0).cast("bigint")).alias("longest_source"))
    return documents, named.select(F.when(~F.col("missing"), F.col("key")).alias("doc_id"), "chunk", "place", "edges")
