"""Session helpers: settings for tests and bench, and lineage cutting."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cpus: int | str = 8, app: str = "ablaspark", memory: str = "8g") -> SparkSession:
    """A local session for tests and bench. On a cluster, use the session you are given."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: the one named in ``spark.checkpoint.dir``.

    Only a local session without the setting gets a fresh temporary folder.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    if sc.getCheckpointDir():
        return sc.getCheckpointDir().rsplit("/", 1)[0]
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    return tempfile.mkdtemp(prefix="ablaspark-")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, for tables a query writes and reads back."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and read it back from there.

    The files survive the loss of executors, and every later branch sees the very same rows.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def concurrently(tasks: Sequence[Callable], parallelism: int = 4) -> list:
    """Results of driver-side tasks that each start Spark jobs, in order; the jobs keep the caller's job group.

    Each call has threads of its own, so tasks may call it again. The first error is raised after the running tasks end.
    """
    if len(tasks) < 2 or parallelism < 2:
        return [task() for task in tasks]
    session = SparkSession.getActiveSession()
    kept = inheritable_thread_target(session) if session else lambda task: task
    with ThreadPoolExecutor(min(parallelism, len(tasks))) as pool:
        return [f.result() for f in [pool.submit(kept(task)) for task in tasks]]


def small_side(df: DataFrame, rows: int = 100_000, size: int = 64 << 20) -> DataFrame:
    """Hint a broadcast for a materialised table, only after measuring that it is small.

    Both the rows and their bytes (as text) are bounded. Larger tables are returned as they
    are, and the join shuffles (AQE splits hot keys).
    """
    n, width = df.limit(rows + 1).agg(
        F.count(F.lit(1)), F.sum(F.octet_length(F.to_json(F.struct("*"))))).first()
    return F.broadcast(df) if n <= rows and (width or 0) <= size else df
