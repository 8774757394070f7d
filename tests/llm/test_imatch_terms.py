"""I-Match fingerprints, band and likenesses against a plain version."""

import math
import re
from collections import Counter

import brute
import pytest
import xxhash
from pyspark.sql import functions as F

from ablaspark.llm import imatch


def signed(n):
    return n - (1 << 64) if n >> 63 else n


def mixed(n, seed, size=8):
    """Spark's hash of a long, or of an int of 4 bytes."""
    return xxhash.xxh64_intdigest(int(n).to_bytes(size, "little", signed=True), seed)


def chained(values):
    h = 42
    for v in values:
        h = mixed(v, h)
    return h


def words(text):
    return {signed(xxhash.xxh64_intdigest(w.encode(), 42)) for w in re.split(r"[\x20\x09-\x0D]+", text) if w}


def plain_lexicon(texts, band):
    df = Counter(h for t in texts for h in words(t))
    return {h for h, c in df.items() if band[0] <= math.log(len(texts) / c) <= band[1]}


def plain_fingerprint(text, lexicon):
    """(m, whole, fine, coarse). Like the operator, the lexicon is a bit map."""
    size = max(64, 1 << max(0, imatch.SPREAD * len(lexicon) - 1).bit_length())
    bits = {h % size for h in lexicon}
    found = sorted(h for h in words(text) if h % size in bits) or sorted(words(text))
    power = max(3, len(found).bit_length())

    def hashes(n):
        parts = [[] for _ in range(1 << n)]
        for h in sorted(mixed(7, mixed(h, 42), 4) >> 1 | 1 for h in found):
            parts[h >> 63 - n].append(h)
        return [max(1, chained(p) & 0xFF) if p else 0 for p in parts]

    whole = chained(sorted(mixed(7, mixed(h, 42), 4) >> 1 | 1 for h in found))
    return 1 << power, whole, hashes(power), hashes(power - 1)


def plain_text(fp):
    return ":".join([str(fp[0]), f"{fp[1]:016x}", *["".join(f"{h:02x}" for h in level) for level in fp[2:]]])


def plain_likeness(a, b):
    if a[1] == b[1]:
        return 1.0
    levels = [{fp[0]: fp[2], fp[0] // 2: fp[3]} for fp in (a, b)]
    for m in (max(a[0], b[0]), min(a[0], b[0])):
        if m in levels[0] and m in levels[1]:
            x, y = levels[0][m], levels[1][m]
            return sum(p == q != 0 for p, q in zip(x, y)) / max(1, sum(p > 0 or q > 0 for p, q in zip(x, y)))
    return 0.0


@pytest.mark.parametrize("name,band", [("documents", imatch.IDF_BAND), ("documents", (2.5, 4.0)), ("odd", imatch.IDF_BAND), ("odd", (0.5, 2.0))])
def test_every_column(documents, odd, name, band):
    df = documents if name == "documents" else odd.filter(
        "doc_id is not null and text is distinct from 'same id, other text'").dropDuplicates(["doc_id"])
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    lexicon = plain_lexicon([t or "" for _, t in rows], band)
    shown = df.select(F.coalesce("text", F.lit("")).alias("text"))
    assert {r["h"] for r in imatch.lexicon(shown, "text", band).collect()} == lexicon
    prints = {i: plain_fingerprint(t or "", lexicon) for i, t in rows}
    got = {r["doc_id"]: r for r in imatch.edited_fingerprints(df, band=band).collect()}
    chars = {"text": 0, "print": 0}
    for i, (text, edited, following) in brute.edited(rows).items():
        other, r = plain_fingerprint(edited, lexicon), got[i]
        assert (r["fingerprint"], r["edited_fingerprint"]) == (plain_text(prints[i]), plain_text(other))
        assert r["near_edited"] == pytest.approx(plain_likeness(prints[i], other), abs=1e-12)
        assert r["near_next"] == pytest.approx(plain_likeness(prints[i], prints[following]), abs=1e-12)
        chars["text"] += len(text)
        chars["print"] += len(r["fingerprint"])
    if name == "documents":
        assert chars["print"] < 0.5 * chars["text"]


def test_texts_on_either_side_of_a_power_are_compared(spark):
    base = [f"t{i}" for i in range(127)]
    rows = [(0, " ".join(base)), (1, " ".join([*base, "one", "two"])), (2, " ".join(base[:20]))]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r["doc_id"]: r for r in imatch.edited_fingerprints(df, band=(-1.0, 99.0)).collect()}
    assert 0.9 < got[0]["near_next"] < 1 and got[1]["near_next"] == 0 and got[2]["near_next"] == 0


def test_one_replaced_term_of_a_long_text_shows(spark):
    words = [f"t{i}" for i in range(5000)]
    texts = [" ".join(words)] + [" ".join(words[:k] + [f"new{k}"] + words[k + 1:]) for k in range(0, 5000, 500)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    bits = imatch.band_bits(df, "text", (-1.0, 99.0))
    marked = df.select("doc_id", imatch.fingerprint(F.col("text"), bits).alias("a"))
    first = marked.filter("doc_id = 0").select(F.col("a").alias("b"))
    got = marked.filter("doc_id > 0").crossJoin(first).select(
        imatch.as_text(F.col("a")).alias("x"), imatch.as_text(F.col("b")).alias("y"), imatch.likeness(F.col("a"), F.col("b")).alias("near")).collect()
    assert len({r["x"] for r in got}) == 10 and all(r["x"] != r["y"] and 0.999 < r["near"] < 1 for r in got)
