"""Secret scanning with an incremental ledger of blobs.

Every version of every document is content-addressed (SHA-256). The ledger has a row for each
blob and rule version that was scanned, with its findings, also when there are none. A run scans
only pairs the ledger does not have, appends them, and joins the findings back to all paths.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from .common import stored, text_or_empty


@dataclass(frozen=True)
class Rule:
    """A kind of secret: matches of ``pattern`` whose ``group`` has at least ``least`` characters.

    A change of pattern or length needs a new version, which makes every blob unseen for the rule.
    """

    kind: str
    version: int
    pattern: str
    least: int
    group: int = 0

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"


def _any_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_KEYWORDS = "|".join(map(_any_case, ("password", "passwd", "secret", "token", "api_?key")))

#: The three base patterns, then published token formats. The order ranks spans that start together.
RULES = (
    Rule("assign", 1, rf"""(?:{_KEYWORDS})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 12, 1),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 18),
    # A run of a class is matched whole, so asking for its least length finds the same spans, and faster.
    Rule("hex", 1, r"[0-9a-f]{16,}", 16),
    Rule("github", 1, r"gh[pousr]_[A-Za-z0-9]+", 40),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 30),
    Rule("pem", 1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 20),
)

LEDGER = "blob string, scanned array<string>, findings array<struct<rule:string,start:int,end:int>>"


def spans(text: str, rule: Rule) -> list[tuple[int, int]]:
    """Leftmost matches that don't overlap, in code points; those too short are dropped after matching."""
    return [m.span() for m in re.finditer(rule.pattern, text) if m.end(rule.group) - m.start(rule.group) >= rule.least]


def _scanner(rules: tuple[Rule, ...]):
    named = {r.name: r for r in rules}

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"blob": batch["blob"], "scanned": batch["missing"], "findings": [
                [{"rule": name, "start": a, "end": b} for name in missing for a, b in spans(text, named[name])]
                for text, missing in zip(batch["text"], batch["missing"])]})

    return scan


class Ledger:
    """The table of scanned blobs in a shared folder; each run appends the pairs it scanned."""

    def __init__(self, spark: SparkSession, folder: str | None = None):
        self.spark, self.folder = spark, folder or scratch_path(spark, "blob-ledger")

    def rows(self) -> DataFrame:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        there = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)
        return self.spark.read.schema(LEDGER).parquet(self.folder) if there else self.spark.createDataFrame([], LEDGER)

    def append(self, rows: DataFrame) -> None:
        rows.write.mode("append").parquet(self.folder)


def scan_versions(versions: DataFrame, ledger: Ledger, rules: tuple[Rule, ...] = RULES, path: str = "doc_id",
                  text: str = "text") -> DataFrame:
    """One row per row of ``versions``: path, blob, findings array<struct<start, place, kind, end>> in order.

    A blob is read once, at the smallest path that holds it, for the rule versions that the ledger doesn't have;
    copies, versions that come back and repeated rows are served from the ledger. A null text counts as empty,
    a null path is a path. Other columns are ignored. An empty table scans nothing and gives no rows.
    """
    rows = versions.select(F.col(path).alias("path"), text_or_empty(text).alias("text"))
    light = stored(rows.select("path", F.sha2("text", 256).alias("blob")), "blobs")
    seen = ledger.rows().groupBy("blob").agg(F.flatten(F.collect_list("scanned")).alias("seen"))
    unseen = F.array_except(F.array(*[F.lit(r.name) for r in rules]), F.coalesce("seen", F.array().cast("array<string>")))
    places = light.groupBy("blob", "path").agg(F.count(F.lit(1)).alias("rows"))
    todo = places.groupBy("blob").agg(F.min("path").alias("at"), F.coalesce(F.min_by("rows", "path"), F.max("rows")).alias("rows")).join(
        seen, "blob", "left").select("at", "blob", "rows", unseen.alias("missing")).filter(F.size("missing") > 0)
    here = F.col("path").eqNullSafe(F.col("at")) & (F.sha2("text", 256) == F.col("blob"))
    fresh = rows.join(stored(todo, "unseen"), here).select("blob", "text", "missing", "rows")
    # only where rows repeat, path and text, are their texts brought together
    once = fresh.filter("rows > 1").groupBy("blob", "missing").agg(F.first("text").alias("text")).select("blob", "text", "missing")
    ledger.append(fresh.filter("rows = 1").drop("rows").unionByName(once).mapInPandas(_scanner(rules), LEDGER))

    place = F.create_map(*[F.lit(x) for i, r in enumerate(rules) for x in (r.name, i)])
    kind = F.create_map(*[F.lit(x) for r in rules for x in (r.name, r.kind)])
    current = F.array_distinct(F.flatten(F.collect_list(F.filter("findings", lambda f: f["rule"].isin(
        [r.name for r in rules])))))
    secrets = stored(ledger.rows().filter(F.size("findings") > 0).groupBy("blob").agg(current.alias("findings")).select(
        "blob", F.array_sort(F.transform("findings", lambda f: F.struct(
            f["start"].alias("start"), place[f["rule"]].alias("place"), kind[f["rule"]].alias("kind"),
            f["end"].alias("end")))).alias("findings")), "findings")
    return light.join(secrets, "blob", "left").select("path", "blob", F.coalesce("findings", F.array().cast(
        "array<struct<start:int,place:int,kind:string,end:int>>")).alias("findings"))


def span_columns(scanned: DataFrame, base: tuple[str, ...] = ("assign", "access", "hex")) -> DataFrame:
    """doc_id, a count for each base kind, the SHA-256 of the base spans, and all spans as text."""
    def joined(findings):
        return F.array_join(F.transform(findings, lambda f: F.concat_ws(
            ":", f["kind"], f["start"].cast("string"), f["end"].cast("string"))), ",")

    def count(kind):
        return F.size(F.filter("findings", lambda f: f["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    kept = F.filter("findings", lambda f: f["kind"].isin(*base))
    return scanned.select(F.col("path").alias("doc_id"), *map(count, base), F.sha2(joined(kept), 256).alias("base_sha256"),
                          joined(F.col("findings")).alias("spans"))
