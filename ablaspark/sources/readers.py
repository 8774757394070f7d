"""Sources: labelled CSV, named tables, JSON record files, result trees."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Loader = Callable[[SparkSession], DataFrame]


def scan_csv_labeled(spark: SparkSession, path: str, target: str | None = None,
                     schema: T.StructType | str | None = None) -> tuple[DataFrame, str]:
    """A CSV table and its target column: the named one, or the last. Give a schema to skip inference."""
    reader = spark.read.option("header", True)
    df = reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)
    target = target or df.columns[-1]
    if target not in df.columns:
        raise ValueError(f"target column '{target}' not found; available: {df.columns}")
    return df, target


class NamedSources:
    """A registry of named tables."""

    def __init__(self):
        self._loaders: dict[str, Loader] = {}

    def register(self, name: str, loader: Loader) -> None:
        self._loaders[name] = loader

    def register_parquet(self, name: str, path: str) -> None:
        self.register(name, lambda spark: spark.read.parquet(path))

    def names(self) -> list[str]:
        return list(self._loaders)

    def load(self, spark: SparkSession, name: str) -> DataFrame:
        if name not in self._loaders:
            raise ValueError(f"unknown dataset '{name}'; available: {self.names()}")
        return self._loaders[name](spark)


def scan_json_records(spark: SparkSession, path: str, schema: T.StructType | str) -> tuple[DataFrame, DataFrame]:
    """Records of JSON array files, and (file, note) rows for files that could not be read.

    One multi-line file is one unit of work, so many files spread over the cluster.
    """
    typed = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    full = T.StructType([*typed.fields, T.StructField("_corrupt_record", T.StringType())])
    raw = spark.read.option("multiLine", True).option("mode", "PERMISSIVE").schema(full).json(path).select(
        "*", F.col("_metadata.file_path").alias("file"))
    good = raw.where("_corrupt_record is null").drop("_corrupt_record")
    # The reader wants a data field next to the corrupt record; it is NULL for a broken file.
    field = F.expr(f"coalesce(max(cast(`{typed.fieldNames()[0]}` as string)), 'unreadable, skipped')")
    bad = raw.where("_corrupt_record is not null").groupBy("file").agg(field.alias("note"))
    return good, bad


SUMMARY_SCHEMA = ("configuration string, mean double, std double, min double, max double, ci_lower double,"
                  " ci_upper double, n_runs bigint")


def scan_result_tree(spark: SparkSession, root: str, schema: str = SUMMARY_SCHEMA,
                     pattern: str = "summary_statistics_*.csv") -> DataFrame:
    """All result files below a root, each row tagged with its experiment (relative directory) and file.

    A file whose header does not match the schema is an error, not silently misread.
    """
    raw = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).option(
        "header", True).option("enforceSchema", False).schema(schema).csv(root)
    base = root.rstrip("/")
    tagged = raw.select(F.col("_metadata.file_path").alias("summary_file"), "*")
    relative = F.regexp_extract("summary_file", rf"^.*?{_escape(base)}/(?:(.*)/)?[^/]+$", 1)
    return tagged.select(relative.alias("experiment"), "*")


def _escape(text: str) -> str:
    return "".join("\\" + c if c in r"\.^$*+?()[]{}|" else c for c in text)
