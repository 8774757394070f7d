"""Exact deduplication: two-pass Bloom filtering in front of the shuffle.

Pass one counts, with map-side combining, how often each filter position is set and keeps the
positions set more than once. Pass two probes every row: a row whose positions were not all
set twice cannot have a copy and passes straight through; only the others shuffle, and they
are grouped by the SHA-256 of the normalised text, so false positives never change a result.

The filter is broadcast. Its size is bounded by ``MAX_WORDS`` words of 64 bits whatever the
input; beyond about ``64 * MAX_WORDS / BITS_PER_ROW`` rows it fills up and lets more rows (ids and
digests, never texts) into the shuffle, which stays right and merely saves less.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANK_RUN, numbered, power_of_two, stored, text_or_empty

BITS_PER_ROW = 16
MAX_WORDS = 1 << 21


def normalised(text: str) -> Column:
    return F.regexp_replace(text_or_empty(text), BLANK_RUN, "")


def _positions(words: int) -> list[Column]:
    """Word of the filter, and the two bits of the row in it, from disjoint bits of the hash."""
    h = F.xxhash64("text_sha256")
    return [h.bitwiseAND(F.lit(words - 1)).alias("word"), F.shiftrightunsigned(h, 58).cast("int").alias("bit_a"),
            F.shiftrightunsigned(h, 52).bitwiseAND(F.lit(63)).cast("int").alias("bit_b")]


def repeated_positions(rows: DataFrame) -> DataFrame:
    """Filter words (word, bits) with the bits that more than one row sets."""
    single = rows.select("word", F.explode(F.array_distinct(F.array("bit_a", "bit_b"))).alias("bit"))
    twice = single.groupBy("word", "bit").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return twice.groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits"))


def exact_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical without ASCII white space; a null text counts as empty. Of
    equal texts the one with the most code points stays, then the smallest doc_id (null last), and
    of rows that tie in both exactly one. Other columns are ignored, whatever their names. An
    empty table gives an empty result.
    """
    light = stored(docs.select(*_light(doc_id, text), F.monotonically_increasing_id().alias("row_no")), "exact-dedup")
    return _decide(light, *_filter(light)).drop("row_no")


def _light(doc_id: str, text: str) -> list[Column]:
    """What decides about a row, without its text."""
    return [F.col(doc_id).alias("doc_id"), F.length(text_or_empty(text)).cast("bigint").alias("chars"),
            F.sha2(normalised(text), 256).alias("text_sha256")]


def _filter(light: DataFrame) -> tuple[int, DataFrame]:
    """Pass one: the size of the filter, and its words with repeated bits."""
    words = power_of_two(light.count() * BITS_PER_ROW / 64, 64, MAX_WORDS)
    return words, stored(repeated_positions(light.select(*_positions(words))), "exact-dedup-filter")


def _probed(rows: DataFrame, words: int, repeats: DataFrame) -> DataFrame:
    """Pass two: rows with a digest get ``maybe``; false means that no other row has the digest."""
    both = F.expr("shiftleft(1L, bit_a) | shiftleft(1L, bit_b)")
    return rows.select("*", *_positions(words)).join(F.broadcast(repeats), "word", "left").withColumn(
        "maybe", F.coalesce(F.col("bits").bitwiseAND(both) == both, F.lit(False)))


def _decide(light: DataFrame, words: int, repeats: DataFrame) -> DataFrame:
    probed = _probed(light, words, repeats)
    passed = probed.filter("not maybe").select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"),
        F.lit(True).alias("kept"), "text_sha256", "row_no")
    maybe = probed.filter("maybe").select("doc_id", "chars", "text_sha256", "row_no")
    first = F.min(F.struct((-F.col("chars")).alias("c"), F.col("doc_id").isNull().alias("n"), "doc_id", "row_no"))
    groups = stored(maybe.groupBy("text_sha256").agg(first.alias("first"), F.count(F.lit(1)).alias("group_size")),
                    "exact-dedup-groups")
    grouped = maybe.join(groups, "text_sha256").select(
        "doc_id", F.col("first.doc_id").alias("keep_id"), "group_size",
        (F.col("row_no") == F.col("first.row_no")).alias("kept"), "text_sha256", "row_no")
    return passed.unionByName(grouped)


def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that exact_dedup keeps, all columns.

    Rows that the filter clears pass straight through with their texts; only the others shuffle.
    """
    held = numbered(docs, *_light(doc_id, text))
    light = held.drop("row")
    words, repeats = _filter(light)
    gone = stored(_decide(light, words, repeats).filter("not kept").select("row_no"), "exact-copies")
    rows = _probed(held, words, repeats)
    return rows.filter("not maybe").select("row.*").unionByName(
        rows.filter("maybe").join(gone, "row_no", "left_anti").select("row.*"))
