"""I-Match document fingerprints over randomised lexicon subsets.

Terms whose inverse document frequency lies in a band form the lexicon. Its upper edge is fixed, so the lexicon has at
most e^edge times as many terms as a mean document, however many documents there are; frequencies are counted per term over
all documents. For a text with n lexicon terms the lexicon is split at random (by a hash of the term) into M disjoint subsets,
M the smallest power of two above n, so a subset holds about one term of the text and an edit leaves many alone. The fingerprint
has a hash of the sorted distinct terms in each of the M subsets, and in each of M / 2, so that texts on either side of a power
can be compared; every lexicon term is in one subset of each. These hashes have 8 bits, which keeps the fingerprint well below
the text (one changed subset in 255 goes unseen); a 64-bit hash of all lexicon terms tells different texts apart.
Likeness is the share of equal subset hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BLANK_RUN, power_of_two, stored, text_or_empty

IDF_BAND = (1.5, 8.0)
LEAST_BITS = 3
#: Bits per term of the lexicon's bit map (another term shares a lexicon term's bit once in so many times), and the most bits.
SPREAD, MOST_BITS = 16, 1 << 25
_EMPTY = -(1 << 7)  # 8-bit hashes are kept as signed integers; no hash of a subset with terms is this one
_FIRST = -(1 << 63)  # a null id sorts before every other


def terms(text: Column) -> Column:
    """Hashes of the distinct words of a text."""
    words = F.filter(F.split(text, BLANK_RUN), lambda w: w != "")
    return F.transform(F.array_distinct(words), lambda w: F.xxhash64(w))


def lexicon(documents: DataFrame, text: str, band: tuple[float, float] = IDF_BAND) -> DataFrame:
    """The terms (h) whose inverse document frequency lies in the band."""
    counted = documents.select(F.explode(terms(F.col(text))).alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log(F.lit(float(max(documents.count(), 1))) / F.col("df"))
    return counted.filter(idf.between(*band)).select("h")


def band_bits(documents: DataFrame, text: str, band: tuple[float, float] = IDF_BAND) -> str:
    """A bit map of the lexicon as 64-bit words joined by commas: bit (hash mod bits) of every term."""
    held = stored(lexicon(documents, text, band), "lexicon")
    size = power_of_two(SPREAD * held.count(), 64, MOST_BITS)
    place = F.col("h").bitwiseAND(F.lit(size - 1))
    words = held.groupBy(F.shiftright(place, 6).alias("word")).agg(F.bit_or(
        F.expr("shiftleft(1L, cast(h & 63 as int))")).alias("bits"))
    bits = [0] * (size // 64)
    for r in words.collect():  # at most MOST_BITS / 64 rows
        bits[r["word"]] = r["bits"]
    return ",".join(map(str, bits))


def _bind(value: Column, use) -> Column:
    """use(value), with value computed once."""
    return F.transform(F.array(value), use)[0]


def _in_band(bits: str, hashes: Column) -> Column:
    """Lexicon terms of a text; all its terms if it has none (texts without lexicon terms would all be alike)."""
    size = 64 * (bits.count(",") + 1)
    table = F.split(F.lit(bits), ",").cast("array<bigint>")  # folded into one literal

    def inside(h: Column) -> Column:
        word = F.shiftright(h.bitwiseAND(F.lit(size - 1)), 6).cast("int")
        return F.getbit(F.get(table, word), h.bitwiseAND(F.lit(63)).cast("int")) == 1

    return _bind(hashes, lambda every: _bind(F.filter(every, inside), lambda kept: F.when(
        F.size(kept) > 0, kept).otherwise(every)))


def _subsets(found: Column, bits: Column) -> Column:
    """The sorted terms of each of 2^bits lexicon subsets, in order; a subset is a range of the terms' second hashes.

    Terms (odd numbers) and a mark per subset (its lower end) are sorted together, and the marks cut the order.
    """
    width = F.lit(63) - bits
    first = F.lit(1).cast("bigint")
    shifted = lambda k: F.call_function("shiftleft", k, width)
    marks = F.transform(F.sequence(F.lit(0).cast("bigint"), F.call_function("shiftleft", first, bits) - 1), shifted)
    own = F.transform(found, lambda h: F.shiftrightunsigned(F.xxhash64(h, F.lit(7)), 1).bitwiseOR(F.lit(1)))

    def cut(every: Column) -> Column:
        starts = F.filter(F.transform(every, lambda x, i: F.when(x.bitwiseAND(F.lit(1)) == 0, i).otherwise(-1)), lambda i: i >= 0)
        return _bind(starts, lambda s: F.transform(s, lambda start, j: F.slice(
            every, start + 2, F.coalesce(F.get(s, j + 1), F.size(every)) - start - 1)))

    return _bind(F.sort_array(F.concat(marks, own)), cut)


def fingerprint(text: Column, bits: str) -> Column:
    """struct(m, whole: hash of all sorted lexicon terms, fine and coarse: hashes of m and of m / 2 subsets)."""
    def hashed(part: Column) -> Column:
        short = F.greatest(F.xxhash64(part).bitwiseAND(F.lit(0xFF)), F.lit(1)) + _EMPTY
        return F.when(F.size(part) > 0, short).otherwise(F.lit(_EMPTY)).cast("tinyint")

    def levels(parts: Column) -> Column:
        halves = F.sequence(F.lit(0), F.shiftright(F.size(parts), 1) - 1)
        coarse = F.transform(halves, lambda j: _bind(F.concat(F.get(parts, 2 * j), F.get(parts, 2 * j + 1)), hashed))
        return F.struct(F.size(parts).alias("m"), F.xxhash64(F.flatten(parts)).alias("whole"),
                        F.transform(parts, hashed).alias("fine"), coarse.alias("coarse"))

    def shape(found: Column) -> Column:
        power = F.greatest(F.lit(LEAST_BITS), F.floor(F.log2(F.greatest(F.size(found), F.lit(1)))) + 1).cast("int")
        return _bind(_subsets(found, power), levels)

    return _bind(_in_band(bits, terms(text)), shape)


def as_text(fp: Column) -> Column:
    hexed = lambda a: F.array_join(F.transform(a, lambda h: F.lower(F.lpad(F.hex(h.cast("bigint") - _EMPTY), 2, "0"))), "")
    return F.concat_ws(":", fp["m"].cast("string"), F.lower(F.lpad(F.hex(fp["whole"]), 16, "0")), hexed(fp["fine"]), hexed(fp["coarse"]))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal hashes among the subsets in which either text has a term, at the finest number of subsets that both have.

    1 if all lexicon terms are the same; 0 if they share no number of subsets: one has more than twice the terms of the other.
    """
    def share(x: Column, y: Column) -> Column:
        count = lambda test: F.size(F.filter(F.zip_with(x, y, test), lambda t: t))
        return count(lambda p, q: (p == q) & (p != _EMPTY)) / F.greatest(count(lambda p, q: (p != _EMPTY) | (q != _EMPTY)), F.lit(1))

    return (F.when(a["whole"] == b["whole"], F.lit(1.0)).when(a["m"] == b["m"], share(a["fine"], b["fine"]))
            .when(a["m"] == 2 * b["m"], share(a["coarse"], b["fine"])).when(2 * a["m"] == b["m"], share(a["fine"], b["coarse"]))
            .otherwise(F.lit(0.0)))


def next_ids(ids: DataFrame) -> DataFrame:
    """(key, next_key) for the distinct keys in ascending order; after the last comes the first.

    The keys are cut into ranges; only rows of one range share a task, and one row per range is
    looked at to step over the ends.
    """
    ranged = stored(ids.distinct().repartitionByRange("key").withColumn("range", F.spark_partition_id()), "ranges")
    inside = Window.partitionBy("range").orderBy("key")
    heads = ranged.groupBy("range").agg(F.min("key").alias("head"))
    every = Window.partitionBy(F.lit(0)).orderBy("range")
    after = heads.select("range", F.coalesce(F.lead("head").over(every), F.first("head").over(
        every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("after"))
    return ranged.withColumn("next_key", F.lead("key").over(inside)).join(after, "range").select(
        "key", F.coalesce("next_key", "after").alias("next_key"))


def edited_fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                        band: tuple[float, float] = IDF_BAND) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness.

    The last quarter of the code points (rounded down) is replaced by as many from the start of the next
    document by id. Null texts count as empty, a null id as the smallest. Of rows that share
    an id, the text with the smallest SHA-256 is the one that the previous document borrows from and is compared with.
    A single document is its own next one. Other columns are ignored; an empty table gives no rows.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), text_or_empty(text).alias("text"))
    bits = band_bits(rows, "text", band)
    # Both joins below read this one exchange; they need the very same columns for that.
    keyed = rows.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(_FIRST)).alias("key"), "text").repartition("key")
    sizes = stored(docs.select(F.coalesce(F.col(doc_id).cast("bigint"), F.lit(_FIRST)).alias("key"),
                               F.floor(F.length(text_or_empty(text)) / 4).cast("int").alias("quarter")), "quarters")
    steps = next_ids(sizes.select("key"))
    wanted = sizes.groupBy("key").agg(F.max("quarter").alias("quarter")).join(steps, "key")
    # the row of an id that lends its text is the one it is compared with
    lent = wanted.select(F.col("key").alias("to"), F.col("next_key").alias("key"), "quarter").join(keyed, "key").select(
        "to", "key", F.sha2("text", 256).alias("lends"), F.substring(F.col("text"), F.lit(1), F.col("quarter")).alias("loan"),
        fingerprint(F.col("text"), bits).alias("c"))
    loans = lent.groupBy("to", "key").agg(F.min_by(F.struct("loan", "c"), "lends").alias("x")).select(
        F.col("to").alias("key"), "x.loan", "x.c")
    quarter = F.floor(F.length("text") / 4).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.length("text") - quarter),
                      F.substring(F.col("loan"), F.lit(1), quarter))
    marked = keyed.join(loans, "key").select("key", "text", edited.alias("edited"), "c").select(
        "key", F.length("text").cast("bigint").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint(F.col("text"), bits).alias("a"), fingerprint(F.col("edited"), bits).alias("b"), "c")
    return marked.select(
        F.when(F.col("key") != _FIRST, F.col("key")).alias("doc_id"), "n_chars", "edited_sha256", as_text(F.col("a")).alias("fingerprint"),
        as_text(F.col("b")).alias("edited_fingerprint"), likeness(F.col("a"), F.col("b")).alias("near_edited"),
        likeness(F.col("a"), F.col("c")).alias("near_next"))
