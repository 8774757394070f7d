"""Watching a folder of generated files: new versions, largest file, state log."""

from __future__ import annotations

import json
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupStateTimeout
from pyspark.sql.types import TimestampType

from ..functions.safe import q
from ..session import cut_lineage


def file_stream(spark: SparkSession, root: str, pattern: str = "*.py", files_per_trigger: int | None = None) -> DataFrame:
    """(path, mtime, size, hash) of files as they appear; the hash is the first 12 digits of SHA-256."""
    reader = spark.readStream.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    raw = reader.schema("path string, modificationTime timestamp, length bigint, content binary").load(root)
    return raw.selectExpr("path", "modificationTime as mtime", "length as size",
                          "substring(sha2(content, 256), 1, 12) as hash")


def with_dataset(files: DataFrame, datasets: Sequence[str]) -> DataFrame:
    """Keep files below a directory whose name starts with a known dataset, and name it."""
    tests = " ".join(
        f"when exists(slice(split(path, '/'), 1, size(split(path, '/')) - 1), p -> startswith(p, '{d}')) then '{d}'"
        for d in datasets)
    return files.withColumn("dataset", F.expr(f"case {tests} end")).where("dataset is not null")


def _process(group: pd.DataFrame, last: tuple | None, seen_at: str, cooldown: float) -> tuple[pd.DataFrame, tuple | None]:
    """Sightings of one path that are to be processed, and the last one that was."""
    kept = []
    for i, (mtime, digest, at) in enumerate(zip(group["mtime"], group["hash"], group[seen_at])):
        version = (str(mtime), str(digest))
        if last is None or last[:2] != version or (at - last[2]).total_seconds() >= cooldown:
            kept.append(i)
            last = (*version, at)
    return group.iloc[kept], last


def stream_new_files(events: DataFrame, seen_at: str = "seen_at", cooldown: float = 60.0) -> DataFrame:
    """Sightings (path, mtime, hash, seen_at) that are to be processed: a new path, a changed version, or the same
    version again ``cooldown`` seconds after it was last processed.

    The state holds one version per path for good, so no sighting is ever too late; the sightings of a path
    within a micro-batch are taken in order of time. ``stream_ordered_files`` answers in order of time throughout.
    """
    seen = events.select("path", "mtime", "hash", seen_at)

    def step(key, batches, state):
        group = pd.concat(list(batches)).sort_values([seen_at, "mtime", "hash"], kind="stable")
        last = (*state.get[:2], pd.Timestamp(state.get[2], unit="us")) if state.exists else None
        kept, last = _process(group, last, seen_at, cooldown)
        state.update((*last[:2], last[2].value // 1000))
        yield kept

    return seen.groupBy("path").applyInPandasWithState(
        step, seen.schema, "mtime string, hash string, at bigint", "append", GroupStateTimeout.NoTimeout)


def stream_ordered_files(events: DataFrame, lateness: str, seen_at: str = "seen_at", cooldown: float = 60.0, buckets: int = 1024) -> DataFrame:
    """``stream_new_files`` in event time: sightings may come ``lateness`` (an interval) late, in any micro-batch.

    A path's sightings wait in the state until the watermark has passed them and are then judged in order of time
    (then mtime and hash), so the answer does not depend on how they were dealt to micro-batches. Sightings behind the
    watermark are dropped; those at or after the last watermark are still waiting when a stream stops.
    What is known of a path goes ``cooldown`` seconds after it was last processed, since from then on every sighting is due.
    A sighting without time is dropped, one without path belongs to the path NULL.

    Paths share a state by the ``buckets`` of their hash: a call of the state function costs milliseconds, a sighting in it
    microseconds. The number is part of the state and can't change under a checkpoint.
    """
    timed = isinstance(events.schema["mtime"].dataType, TimestampType)
    kind = events.schema["mtime"].dataType.simpleString()
    seen = events.where(F.col(q(seen_at)).isNotNull()).withWatermark(seen_at, lateness).selectExpr(
        f"pmod(xxhash64(path), {int(buckets)}) as bucket", "path",
        "cast(unix_micros(mtime) as string) as mtime" if timed else "cast(mtime as string) as mtime", "hash",
        f"unix_micros({q(seen_at)}) as at", q(seen_at))
    pause = int(cooldown * 1_000_000)
    columns = ["path", "mtime", "hash", "at"]

    def milliseconds(micros):
        return micros // 1000

    def in_time(row):
        return (row[3], *((v is not None, v or "") for v in row[1:3]))

    def step(key, batches, state):
        processed, rows = map(json.loads, state.get) if state.exists else ([], [])
        last = {path: (mtime, digest, at) for path, mtime, digest, at in processed}
        if not state.hasTimedOut:
            for batch in batches:
                texts = (batch[c].astype(object).where(batch[c].notna(), None).tolist() for c in columns[:3])
                rows += map(list, zip(*texts, batch["at"].tolist()))
        now = state.getCurrentWatermarkMs()
        due = []
        for path, mtime, digest, at in sorted((r for r in rows if milliseconds(r[3]) < now), key=in_time):
            before = last.get(path)
            if before is None or before[:2] != (mtime, digest) or at - before[2] >= pause:
                due.append((path, mtime, digest, at))
                last[path] = (mtime, digest, at)
        rows = [r for r in rows if milliseconds(r[3]) >= now]
        processed = [(path, *v) for path, v in last.items() if milliseconds(v[2] + pause + 999) > now]
        if rows or processed:
            state.update((json.dumps(processed), json.dumps(rows)))
            wake = min([milliseconds(r[3]) for r in rows] + [milliseconds(v[3] + pause + 999) for v in processed])
            state.setTimeoutTimestamp(max(wake, now + 1))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(due, columns=columns)

    judged = seen.groupBy("bucket").applyInPandasWithState(
        step, "path string, mtime string, hash string, at bigint", "processed string, waiting string",
        "append", GroupStateTimeout.EventTimeTimeout)
    return judged.selectExpr(
        "path", "timestamp_micros(cast(mtime as bigint)) as mtime" if timed else f"cast(mtime as {kind}) as mtime", "hash",
        f"timestamp_micros(at) as {q(seen_at)}")


def poll_files(spark: SparkSession, root: str, log: str, at: str, pattern: str = "*.py", cooldown: float = 60.0) -> DataFrame:
    """One look at a folder: files that are new, changed or due again, appended to the log table and returned.

    A file stream reports a path once; this also finds rewritten files. ``at`` is the time of the look.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    now = files.selectExpr("path", "modificationTime as mtime", "length as size",
                           "substring(sha2(content, 256), 1, 12) as hash", f"timestamp '{at}' as processed")
    logged = spark.read.schema(now.schema).parquet(log) if _exists(spark, log) else now.limit(0)
    last = logged.groupBy("path").agg(F.expr("max_by(struct(mtime, hash, processed), processed)").alias("last"))
    due = now.join(last, "path", "left").where(
        "last is null or last.mtime != mtime or last.hash != hash or "
        f"cast(processed as double) - cast(last.processed as double) >= {float(cooldown)}").drop("last")
    due = cut_lineage(due)
    due.write.mode("append").parquet(log)
    return due


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def stream_largest_file(files: DataFrame) -> DataFrame:
    """Largest file per dataset (a running aggregate; use update or complete mode)."""
    return files.groupBy("dataset").agg(
        F.expr("max_by(path, struct(size, path))").alias("path"), F.expr("max(size)").alias("size"))


def append_states(events: DataFrame, log: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Append (dataset, state, ts, details) events to a log table, exactly once per input row."""
    writer = events.select("dataset", "state", "ts", "details").writeStream.format("parquet").outputMode(
        "append").option("path", log).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def last_states(events: DataFrame) -> DataFrame:
    """Last state per dataset; works on the log table and on a stream alike."""
    return events.groupBy("dataset").agg(
        F.expr("max_by(state, struct(ts, state))").alias("state"), F.expr("max(ts)").alias("ts"))
