"""Language identification with interpolated Kneser-Ney character models.

Each language has an interpolated Kneser-Ney model of character n-grams. The models stand side
by side in sorted arrays of n-gram hashes: one row per n-gram known to any language, one
column per language with the finished log probability, and the same for the back-off weights
of contexts. A text gets the language with the lowest length-normalised cross-entropy. Texts whose
best cross-entropy lies above what the calibration texts of that language show for their length are
rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored, text_or_empty

ORDER = 4
#: Documented bound: about this many documents of a language are fitted on, and CALIBRATE of 8 parts are held back.
DOCS_PER_LANGUAGE = 1500
CALIBRATE = 2
#: A text is rejected beyond MARGIN times the largest deviation of a calibration text, never within LEAST_EXCESS nats
#: per character of the usual cross-entropy (a few calibration texts show too little).
MARGIN = 1.5
LEAST_EXCESS = 1.2
#: Characters that the uniform distribution below the unigrams spreads over.
ALPHABET = 4096
UNKNOWN = "und"
_BLANK = 32
_BLOCK = 1 << 18
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def letters(text: str) -> np.ndarray:
    """Code points of the lower-cased text, every run of other characters than letters as one blank; begins and
    ends with a blank. Empty if there is no letter."""
    low = text.lower()
    points = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    seen, inverse = np.unique(points, return_inverse=True)
    is_letter = np.array([chr(c).isalpha() for c in seen.tolist()], dtype=bool)[inverse]
    if not is_letter.any():
        return np.zeros(0, dtype=np.uint32)
    kept = is_letter | np.concatenate(([False], is_letter[:-1]))
    out = np.where(is_letter, points, _BLANK)[kept].astype(np.uint32)
    ends = [] if out[-1] == _BLANK else [_BLANK]
    return np.concatenate(([_BLANK], out, ends)).astype(np.uint32)


def gram_hashes(codes: np.ndarray, order: int) -> list[np.ndarray]:
    """hashes[n - 1][i]: of the n characters that end at i (those before the start count as zero)."""
    single = codes.astype(np.uint64) + np.uint64(1)
    running, power, out = np.zeros(len(codes), np.uint64), np.uint64(1), []
    with np.errstate(over="ignore"):
        for n in range(order):
            shifted = np.zeros_like(single)
            shifted[n:] = single[:len(single) - n]
            running = running + shifted * power
            power = power * np.uint64(0x100000001B3)
            mixed = (running ^ (running >> np.uint64(29))) * _MULTIPLIER
            out.append(mixed ^ (mixed >> np.uint64(32)))
    return out


def padded(codes: np.ndarray, order: int) -> np.ndarray:
    return np.concatenate((np.full(order - 1, _BLANK, np.uint32), codes))


class HashArray:
    """A sorted hash array with an index on the upper bits; ``find`` gives positions, -1 for unknown."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.shift = np.uint64(64 - max(1, int(4 * len(keys)).bit_length()))
        slots = np.arange((1 << (64 - int(self.shift))) + 1, dtype=np.uint64)
        self.first = np.searchsorted(keys >> self.shift, slots).astype(np.int32)
        self.widest = int(np.diff(self.first).max()) if len(keys) else 0
        self.padded = np.concatenate((keys, np.zeros(self.widest + 1, np.uint64)))

    def find(self, wanted: np.ndarray) -> np.ndarray:
        slot = (wanted >> self.shift).astype(np.int64)
        at, end = self.first[slot], self.first[slot + 1]
        found = np.where((at < end) & (self.padded[at] == wanted), at, -1)
        rest = np.flatnonzero((found < 0) & (end - at > 1))
        for step in range(1, self.widest):
            if not len(rest):
                break
            here = at[rest] + step
            hit = (here < end[rest]) & (self.padded[here] == wanted[rest])
            found[rest[hit]] = here[hit]
            rest = rest[~hit & (here + 1 < end[rest])]
        return found


@dataclass
class Model:
    languages: list[str]
    order: int
    grams: list[HashArray] = field(default_factory=list)  # by order
    log_p: list[np.ndarray] = field(default_factory=list)
    contexts: list[HashArray] = field(default_factory=list)  # of orders 2 and up
    log_backoff: list[np.ndarray] = field(default_factory=list)
    mean: np.ndarray | None = None
    spread: np.ndarray | None = None
    reach: np.ndarray | None = None
    unseen: np.ndarray | None = None  # log probability of an unknown character

    def log_probabilities(self, codes: np.ndarray) -> np.ndarray:
        """Per character and language; the first order - 1 characters are only context."""
        hashes = gram_hashes(codes, self.order)
        skip = self.order - 1
        out = np.zeros((len(codes) - skip, len(self.languages)), np.float32)
        open_ = np.arange(skip, len(codes))
        for n in range(self.order, 0, -1):
            at = self.grams[n - 1].find(hashes[n - 1][open_])
            known = at >= 0
            out[open_[known] - skip] += self.log_p[n - 1][at[known]]
            open_ = open_[~known]
            if not len(open_):
                break
            if n > 1:
                context = self.contexts[n - 2].find(hashes[n - 2][open_ - 1])
                seen = context >= 0
                out[open_[seen] - skip] += self.log_backoff[n - 2][context[seen]]
            else:
                out[open_ - skip] += self.unseen
        return out

    def entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy per character (texts x languages) and characters per text; 0 characters: no letter."""
        skip = self.order - 1
        total, size = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts), np.int64)
        parts, owners, held = [], [], 0

        def flush():
            nonlocal held
            if parts:
                scores = self.log_probabilities(np.concatenate(parts))
                # what lies between two parts is the padding of the second
                starts = np.cumsum([0] + [len(p) for p in parts[:-1]])
                for own, a, part in zip(owners, starts, parts):
                    total[own] -= scores[a:a + len(part) - skip].sum(axis=0, dtype=np.float64)
                parts.clear()
                owners.clear()
                held = 0

        for own, text in enumerate(texts):
            codes = letters(text)
            size[own] = max(0, len(codes) - 1)  # the leading blank is context
            if not len(codes):
                continue
            whole = padded(codes[1:], self.order)
            for a in range(skip, len(whole), _BLOCK):
                parts.append(whole[a - skip:a + _BLOCK])
                owners.append(own)
                held += len(parts[-1])
                if held >= _BLOCK:
                    flush()
        flush()
        return total / np.maximum(size, 1)[:, None], size

    def judge(self, entropies: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best language, and whether its cross-entropy is too far above the usual one for the length."""
        best = entropies.argmin(axis=1)
        over = entropies[np.arange(len(best)), best] - self.mean[best]
        allowed = MARGIN * self.reach[best] * self.spread[best] * length_factor(size)
        return best, over > np.maximum(allowed, LEAST_EXCESS)


def length_factor(size):
    """Short texts scatter more."""
    return 1 + 8 / np.sqrt(np.maximum(size, 1))


def _discount(counts: np.ndarray) -> float:
    ones, twos = int((counts == 1).sum()), int((counts == 2).sum())
    return ones / (ones + 2 * twos) if ones and twos else 0.5


def build(counts: pd.DataFrame, languages: list[str], order: int = ORDER) -> Model:
    """Models from n-gram counts: language, n, gram, context, suffix, count (hashes as unsigned)."""
    model = Model(languages, order)
    lower, below = None, None
    by = {key: g for key, g in counts.groupby(["language", "n"])}
    for n in range(1, order + 1):
        keys = np.unique(np.concatenate([by[k, n]["gram"].to_numpy() for k in languages if (k, n) in by]))
        array = HashArray(keys)
        p = np.zeros((len(keys), len(languages)))
        weights = []
        for k, language in enumerate(languages):
            rows = by.get((language, n))
            if n < order:  # continuation counts: in how many ways the n-gram is extended to the left
                longer = by[language, n + 1]["suffix"].to_numpy()
                grams, number = np.unique(longer, return_counts=True)
                context = rows.set_index("gram")["context"].reindex(grams).to_numpy() if n > 1 else None
            else:
                grams, number, context = (rows[c].to_numpy() for c in ("gram", "count", "context"))
            d = _discount(number)
            if n == 1:
                share = d * len(grams) / number.sum()
                p[:, k] = share / ALPHABET
                p[array.find(grams), k] += np.maximum(number - d, 0) / number.sum()
                weights.append(share / ALPHABET)
                continue
            found, inverse = np.unique(context, return_inverse=True)
            mass = np.bincount(inverse, weights=number)
            weights.append((found, d * np.bincount(inverse) / mass))
            p[array.find(grams), k] = np.maximum(number - d, 0) / mass[inverse]
        if n == 1:
            model.unseen = np.log(np.array(weights)).astype(np.float32)
        else:
            contexts = HashArray(np.unique(np.concatenate([f for f, _ in weights])))
            backoff = np.ones((len(contexts.keys), len(languages)))
            for k, (found, weight) in enumerate(weights):
                backoff[contexts.find(found), k] = weight
            known = pd.concat([by[k, n] for k in languages if (k, n) in by]).drop_duplicates("gram").set_index("gram").loc[keys]
            at = contexts.find(known["context"].to_numpy())
            own = np.where((at >= 0)[:, None], backoff[at], 1.0)
            p += own * below[lower.find(known["suffix"].to_numpy())]
            model.contexts.append(contexts)
            model.log_backoff.append(np.log(backoff).astype(np.float32))
        model.grams.append(array)
        model.log_p.append(np.log(p).astype(np.float32))
        lower, below = array, p
    return model


COUNTS = "language string, n int, gram bigint, context bigint, suffix bigint, count bigint"


def _counter(order: int):
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for language, group in batch.groupby("language"):
                codes = [padded(c[1:], order) for t in group["text"] if len(c := letters(t))]
                if not codes:
                    continue
                where = np.concatenate([np.arange(len(c)) >= order - 1 for c in codes])
                hashes = gram_hashes(np.concatenate(codes), order)
                at = np.flatnonzero(where)
                for n in range(1, order + 1):
                    gram, first, number = np.unique(hashes[n - 1][at], return_index=True, return_counts=True)
                    at_first = at[first]
                    before = hashes[n - 2] if n > 1 else np.zeros(len(where), np.uint64)
                    yield pd.DataFrame({
                        "language": language, "n": n, "gram": gram.view(np.int64),
                        "context": before[at_first - 1].view(np.int64), "suffix": before[at_first].view(np.int64),
                        "count": number})

    return count


def train(labelled: DataFrame, language: str = "lang", text: str = "text", key: str = "doc_id", order: int = ORDER,
          docs_per_language: int = DOCS_PER_LANGUAGE) -> Model | None:
    """Fit on a sample of about ``docs_per_language`` documents of each language, by a hash of the key.

    Rows without label or without a letter teach nothing. None if no document is left.
    """
    rows = labelled.select(F.col(language).cast("string").alias("language"), F.col(text).cast("string").alias("text"),
                           F.col(key).cast("string").alias("key")).filter("language is not null and text rlike '\\\\p{L}'")
    place = F.pmod(F.xxhash64("key", F.lit(11)), F.lit(1_000_000))
    totals = rows.groupBy("language").agg(F.count(F.lit(1)).alias("n"))
    sample = stored(rows.join(F.broadcast(totals), "language").filter(
        place * F.col("n") < F.lit(1_000_000) * docs_per_language).select(
            "language", "text", F.pmod(F.xxhash64("key", F.lit(12)), F.lit(8)).alias("part")), "language-sample")
    fitted, held = sample.filter(F.col("part") >= CALIBRATE), sample.filter(F.col("part") < CALIBRATE)
    if not fitted.head(1):
        fitted = held
    counts = fitted.mapInPandas(_counter(order), COUNTS).groupBy("language", "n", "gram", "context", "suffix").agg(
        F.sum("count").alias("count")).toPandas()  # bounded by the sample
    if not len(counts):
        return None
    for c in ("gram", "context", "suffix"):
        counts[c] = counts[c].to_numpy().view(np.uint64)
    model = build(counts, sorted(counts["language"].unique()), order)
    calibrate(model, held, docs_per_language)
    return model


def calibrate(model: Model, held: DataFrame, docs_per_language: int) -> None:
    """Usual cross-entropy, its spread and the largest deviation per language, over the documents held back."""
    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            entropies, size = model.entropies(batch["text"].tolist())
            k = np.array([model.languages.index(x) if x in model.languages else -1 for x in batch["language"]])
            yield pd.DataFrame({"k": k, "entropy": entropies[np.arange(len(k)), k], "size": size})

    rows = held.mapInPandas(measure, "k int, entropy double, size bigint").toPandas()  # bounded by the sample
    n = len(model.languages)
    model.mean, model.spread, model.reach = np.full(n, 3.0), np.full(n, 1.0), np.full(n, 6.0)
    for k, group in rows[(rows["k"] >= 0) & (rows["size"] > 0)].groupby("k"):
        model.mean[k] = np.average(group["entropy"], weights=np.minimum(group["size"], 1000))
        model.spread[k] = max(0.05, float(group["entropy"].std(ddof=0)))
        over = (group["entropy"] - model.mean[k]) / (model.spread[k] * length_factor(group["size"].to_numpy()))
        model.reach[k] = max(1.0, float(over.max()))


def _predictor(shared):
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            texts = [t.as_py() for t in batch.column("text")]
            entropies, size = model.entropies(texts)
            best, strange = model.judge(entropies, size)
            gap = entropies - entropies.min(axis=1, keepdims=True)
            score = 1 / np.exp(-gap * np.minimum(size, 200)[:, None]).sum(axis=1)
            none = size == 0
            names = [UNKNOWN if e else model.languages[k] for k, e in zip(best, none)]
            rejected = none | strange
            yield pa.record_batch({
                "doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"), "lang_pred": pa.array(names),
                "score": pa.array(np.where(none, 0.0, score)), "rejected": pa.array(rejected),
                "cross_entropy": pa.array(np.where(none, np.nan, entropies.min(axis=1)), from_pandas=True)})

    return predict


def held_out(doc_id: str) -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


PREDICTION = "doc_id bigint, held_out boolean, lang_pred string, score double, rejected boolean, cross_entropy double"


def identify(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", language: str = "lang") -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, lang_pred, score, rejected, cross_entropy.

    Models learn from documents that are not held out (by the id's CRC-32). A null text or one without a letter
    is ``und`` with score 0 and rejected, as is every text if nothing can be learned. Equal cross-entropies go to the
    first language by name. Null ids are not held out; repeated rows get equal answers. Other columns are ignored.
    """
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), held_out(doc_id).alias("held_out"),
                       text_or_empty(text).alias("text"))
    model = train(docs.filter(~held_out(doc_id)), language, text, doc_id)
    if model is None:
        return rows.select("doc_id", "held_out", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"),
                           F.lit(True).alias("rejected"), F.lit(None).cast("double").alias("cross_entropy"))
    return rows.mapInArrow(_predictor(docs.sparkSession.sparkContext.broadcast(model)), PREDICTION)


def accepted(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", language: str = "lang") -> DataFrame:
    """The rows of ``docs``, all columns, whose text a language model accepts (see identify). None if nothing can be learned."""
    model = train(docs.filter(~held_out(doc_id)), language, text, doc_id)
    if model is None:
        return docs.limit(0)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.as_py() or "" for t in batch.column(text)]
            entropies, size = shared.value.entropies(texts)
            _, strange = shared.value.judge(entropies, size)
            yield batch.filter(pa.array(~strange & (size > 0)))

    return docs.mapInArrow(keep, docs.schema)
