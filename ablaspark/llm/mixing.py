"""Mixing sources to target weights by weighted fair queueing.

Every source is a queue of its documents in shuffled order, repeated for a second epoch. A
document's virtual finish time is the cumulative size of its source up to its end divided by
the source's target, so all queues reach their targets at virtual time 1. Entries are sorted
globally by finish time (range partitions of it) and the total budget cuts the order off.

Running totals never put a source or the whole order in one task: totals of buckets (of the
shuffle hash, or of the finish time) are summed up first, and a task sums inside a bucket.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import small_side
from .common import WORD, numbered, offsets, power_of_two, stored, text_or_empty

#: Documents per (source, bucket) that the number of shuffle buckets aims at, and entries per range of virtual time.
BUCKET_ROWS, RANGE_ROWS = 4096, 1 << 14
#: Ranges of virtual time for the running total of the global order; their totals are broadcast, so there is an upper bound.
FINISH_RANGES = (4096, 1 << 20)


def source_targets(sizes: DataFrame, share: float = 1.5, weights: tuple[int, ...] = (3, 1, 2), epochs: int = 2
                   ) -> DataFrame:
    """Targets (source, source_size, target, sid) from totals (source, source_size).

    Sources in code-point order (null last) get the weights in turn and share ``share`` times the total.
    A target stops at ``epochs`` times its source; what is over goes to the others by weight.
    In order of cap / weight the capped sources come first, so one sorted pass finds the level.
    """
    every = Window.partitionBy(F.lit(0))
    by_name = every.orderBy(F.col("source").asc_nulls_last())
    by_ratio = every.orderBy("ratio", "sid")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.col("sid") - 1) % len(weights) + 1).cast("int"))
    before = F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing))
    return (
        sizes.withColumn("sid", F.row_number().over(by_name)).withColumn("weight", weight)
        .withColumn("cap", F.col("source_size") * epochs)
        .withColumn("ratio", F.col("cap").cast("double") / F.col("weight"))
        .withColumn("budget", F.sum("source_size").over(every) * F.lit(float(share)))
        .withColumn("level", (F.col("budget") - before) / left)
        .withColumn("open", F.col("ratio") > F.col("level"))
        .withColumn("level", F.min(F.when(F.col("open"), F.struct("ratio", "sid", "level"))).over(every)["level"])
        .withColumn("target", F.when(F.col("open"), F.col("level") * F.col("weight"))
                    .otherwise(F.col("cap").cast("double")))
        .select("source", "source_size", "target", "sid", "budget")
    )


def mix(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", share: float = 1.5,
        weights: tuple[int, ...] = (3, 1, 2), epochs: int = 2, keep: tuple[str, ...] = ()) -> DataFrame:
    """Entries of the mix, one row per document and epoch: the columns ``keep``, doc_id, text_hash, size, source_size, target, epoch,
    finish (virtual time), position (words of the mix before it; null if not taken), taken.

    Size is the number of words (a null text has none). A document that its source's target cuts gives only
    the words up to there. The shuffle is the MD5 of the id (of the text's hash, if the id is null), so reruns agree; ties go by id
    and text. Null
    sources are one source, null ids sort first. Repeated rows are documents of their own.
    Empty documents, and every document if all are empty, are taken with 0 words.
    """
    size = F.size(F.regexp_extract_all(text_or_empty(text), F.lit(WORD), F.lit(0))).cast("bigint")
    light = stored(docs.select(
        F.col(doc_id).alias("doc_id"), F.col(source).cast("string").alias("source"), size.alias("size"),
        F.md5(F.coalesce(F.col(doc_id).cast("string"), F.xxhash64(text).cast("string"))).alias("shuffled"),
        F.xxhash64(text).alias("text_hash"), *keep,
    ), "mix-sizes")
    n = light.count()
    digits = 2
    while n > 16 ** digits * BUCKET_ROWS:
        digits += 1
    finishes = power_of_two(n * epochs / RANGE_ROWS, *FINISH_RANGES)
    sizes = light.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = stored(source_targets(sizes, share, weights, epochs), "mix-targets")
    rows = light.join(small_side(targets), light["source"].eqNullSafe(targets["source"])).drop("source").withColumn(
        "bucket", F.substring("shuffled", 1, digits))

    inside = Window.partitionBy("sid", "bucket").orderBy("shuffled", "doc_id", "text_hash")
    starts = offsets(rows.groupBy("sid", "bucket").agg(F.sum("size").alias("words")), ["sid"], "bucket", "words", "base")
    queued = (
        rows.withColumn("rank", F.row_number().over(inside))
        .withColumn("end", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
        .join(starts, ["sid", "bucket"])
        .withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
        .withColumn("end", F.col("end") + F.col("base") + F.col("epoch") * F.col("source_size"))
        .withColumn("finish", F.when(F.col("target") > 0, F.col("end") / F.col("target")))
        .withColumn("share", F.greatest(F.lit(0).cast("bigint"), F.least(
            F.col("size"), F.ceil("target") - (F.col("end") - F.col("size")))))
        .drop("shuffled", "base", "end")
    )
    queued = stored(queued, "mix-queued")

    served = queued.filter("share > 0").withColumn(
        "range", F.least(F.floor(F.col("finish") * finishes), F.lit(finishes)).cast("int"))
    ranges = served.groupBy("range").agg(F.sum("share").alias("words")).withColumn("all", F.lit(0))
    starts = offsets(ranges, ["all"], "range", "words", "base").drop("all")
    order = Window.partitionBy("range").orderBy("finish", "sid", "epoch", "bucket", "rank")
    taken = (
        served.repartitionByRange("range").withColumn("position", F.sum("share").over(
            order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("share"))
        .join(F.broadcast(starts), "range")  # one row a range
        .withColumn("position", F.col("position") + F.col("base"))
        .withColumn("taken", F.greatest(F.lit(0).cast("bigint"), F.least(
            F.col("share"), F.floor("budget") - F.col("position"))))
        .drop("range", "base")
    )
    waiting = queued.filter("share = 0").withColumn("position", F.lit(None).cast("bigint")).withColumn(
        "taken", F.lit(0).cast("bigint"))
    return taken.unionByName(waiting)


def mixed_documents(docs: DataFrame, **names) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, source_size, target, taken (words, repeats counted)."""
    return mix(docs, **names).groupBy("sid", "bucket", "rank", "doc_id", "size", "source_size", "target").agg(
        F.sum("taken").alias("taken")).select("doc_id", "size", "source_size", "target", "taken")


def mixed_rows(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", **how) -> DataFrame:
    """The mix itself with the columns of ``docs``: a row for each time a document is taken.

    Where the mix takes only a part of a document its text is cut after that word (and n_chars, if there, is
    that of the cut text). A text without words is taken once. Each row is a document of its own, also where ids are null or
    repeat or rows are equal. Other columns go along; an empty table gives no rows.
    """
    held = numbered(docs)
    inside = F.col("row")
    light = held.select("row_no", inside[doc_id].alias("doc_id"), inside[source].alias("source"), inside[text].alias("text"))
    entries = mix(light, keep=("row_no",), **how).filter("taken > 0 or size = 0 and epoch = 0").select(
        "row_no", F.col("taken").cast("int").alias("taken"), (F.col("taken") < F.col("size")).alias("partly"))
    words = F.slice(F.regexp_extract_all(text_or_empty("text"), F.lit(WORD), F.lit(0)), F.lit(1), F.col("taken"))
    cut = held.join(entries, "row_no").withColumn("text", inside[text]).withColumn(
        "text", F.when(F.col("partly"), F.array_join(words, " ")).otherwise(F.col("text")))
    changed = {text: F.col("text")}
    if "n_chars" in docs.columns and text != "n_chars":
        changed["n_chars"] = F.when(F.col("partly"), F.length("text")).otherwise(inside["n_chars"]).cast(docs.schema["n_chars"].dataType)
    return cut.select(*[changed.get(c, inside[c]).alias(c) for c in docs.columns])
