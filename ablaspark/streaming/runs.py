"""Summaries of run results that grow while the runs arrive."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.safe import q, real
from ..operators.summaries import finish_statistics


def stream_runs_summary(runs: DataFrame, value: str, by: Sequence[str], confidence: float = 0.95) -> DataFrame:
    """The statistics summary as a running aggregate: state is a handful of moments per group.

    Same expressions as the batch form, so once all input has arrived both agree.
    """
    x = real(q(value))
    moments = runs.groupBy(*by).agg(
        F.expr(f"avg({x})").alias("mean"), F.expr(f"stddev_samp({x})").alias("std"), F.expr(f"min({x})").alias("min"),
        F.expr(f"max({x})").alias("max"), F.expr(f"count({x})").alias("n_runs"))
    return finish_statistics(moments, by, confidence)


def _place(spark: SparkSession, path: str):
    """The file system of a path, and the path."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def versions(spark: SparkSession, path: str) -> list[int]:
    """Committed versions of a table, oldest first: the names of the marks in its ``_committed`` folder."""
    fs, place = _place(spark, f"{path}/_committed")
    return sorted(int(f.getPath().getName()) for f in fs.listStatus(place)) if fs.exists(place) else []


def read_version(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """A committed version of a table, the newest by default. A version that is being written can't be seen."""
    known = versions(spark, path)
    if not known or version is not None and version not in known:
        raise FileNotFoundError(f"{path} has no committed version{'' if version is None else f' {version}'}")
    return spark.read.parquet(f"{path}/v{known[-1] if version is None else version}")


def version_writer(path: str, keys: Sequence[str], keep: int = 5) -> Callable[[DataFrame, int], None]:
    """A writer for ``foreachBatch`` in update mode: version n is the last version before n with the changed rows put in.

    The rows go to a folder of their own, and creating an empty mark commits them, which every store does at once or not at all.
    A batch that is repeated after a crash finds either its mark, and does nothing, or starts from the same earlier version and
    overwrites what was left of it. The newest ``keep`` versions stay, for readers that have begun.
    """
    def store(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        known = versions(spark, path)
        if number in known:
            return
        older = [v for v in known if v < number]
        batch = batch.persist()  # the stateful plan runs once
        try:
            table = batch
            if older:
                last = read_version(spark, path, older[-1])
                changed = batch.select(*[F.col(k).alias(f"__{k}") for k in keys])
                same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys])
                table = last.join(changed, same, "left_anti").unionByName(batch)
            table.write.mode("overwrite").parquet(f"{path}/v{number}")
        finally:
            batch.unpersist()
        fs, mark = _place(spark, f"{path}/_committed/{number}")
        fs.create(mark, True).close()
        for old in older[: max(0, len(older) + 1 - keep)]:
            fs.delete(_place(spark, f"{path}/_committed/{old}")[1], False)
            fs.delete(_place(spark, f"{path}/v{old}")[1], True)

    return store


def keep_versions(summary: DataFrame, keys: Sequence[str], path: str, checkpoint: str, once: bool = True, keep: int = 5) -> StreamingQuery:
    """Keep a versioned table (see ``read_version``) at the newest rows of a running aggregate: only changed groups are sent."""
    writer = summary.writeStream.outputMode("update").foreachBatch(version_writer(path, keys, keep)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
