"""Result tables on disk: comma CSV with a header (or Parquet), one folder per result.

A result is published as a whole. Its rows are written to a version folder of their own; then an empty file in the result's
``_log`` names that version, and with it the result is replaced. Creating a file is atomic on every store Spark writes
to, so a reader sees the old rows or the new ones, and a driver lost before that leaves the old result as it was. The version
before the present one stays for readers that are at it; older ones are removed after a publication, unfinished ones when the next is done.

<folder>/<name>.<fmt>/_log/<number>-<version>    the highest number is the present result
<folder>/<name>.<fmt>/<version>/part-...         its rows
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from haulcomp.sources.tables import scan, typed

# What a run named <save> writes.
SUFFIX = {"single": "", "size": "_size", "removed": "_removed", "removed_summary": "_removed_summ"}
LOG = "_log"
# Versions that stay: the present one and the one before.
KEEP = 2


def result_path(folder: str, name: str, fmt: str = "csv") -> str:
    return f"{folder.rstrip('/')}/{name}.{fmt}"


class _Store:
    """The few file operations a result needs, on whatever store its path names."""

    def __init__(self, spark: SparkSession, path: str):
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self.path = path
        self._fs = self._path(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def names(self, sub: str = "") -> list[str]:
        where = self._path(f"{self.path}/{sub}" if sub else self.path)
        return sorted(f.getPath().getName() for f in self._fs.listStatus(where)) if self._fs.exists(where) else []

    def create(self, sub: str) -> None:
        """An empty file; an error if it is there."""
        self._fs.create(self._path(f"{self.path}/{sub}"), False).close()

    def remove(self, sub: str) -> None:
        self._fs.delete(self._path(f"{self.path}/{sub}"), True)


def versions(spark: SparkSession, folder: str, name: str, fmt: str = "csv") -> list[str]:
    """The published versions of a result, oldest first; those that were removed since included."""
    return [entry.partition("-")[2] for entry in _Store(spark, result_path(folder, name, fmt)).names(LOG)]


def current_path(spark: SparkSession, folder: str, name: str, fmt: str = "csv") -> str:
    """Where the present rows of a result are; a folder without a log, as other programs write, is itself the result."""
    path = result_path(folder, name, fmt)
    published = versions(spark, folder, name, fmt)
    return f"{path}/{published[-1]}" if published else path


def _publish(store: _Store, version: str) -> None:
    log = store.names(LOG)
    number = int(log[-1].partition("-")[0]) + 1 if log else 1
    store.create(f"{LOG}/{number:012d}-{version}")


def _clean(store: _Store) -> None:
    kept = {entry.partition("-")[2] for entry in store.names(LOG)[-KEEP:]}
    for entry in store.names():
        if entry.startswith("v") and entry not in kept:
            store.remove(entry)
    for entry in store.names(LOG)[:-KEEP]:
        store.remove(f"{LOG}/{entry}")


def write_result(
    df: DataFrame, folder: str, name: str, fmt: str = "csv", partition_by: list[str] | None = None
) -> str:
    """Write ``df`` as a new version of <folder>/<name>.<fmt> and publish it; missing is written NA. Returns where the rows are.

    One writer at a time per result, as unfinished versions of others would be removed.
    """
    path = result_path(folder, name, fmt)
    version = f"v{uuid.uuid4().hex}"
    writer = df.write.mode("error").format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True).option("nullValue", "NA")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(f"{path}/{version}")
    store = _Store(df.sparkSession, path)
    _publish(store, version)
    _clean(store)
    return f"{path}/{version}"


def saved(df: DataFrame, folder: str, name: str, fmt: str = "csv", partition_by: list[str] | None = None) -> DataFrame:
    """``df`` as read back from where it was written; for scores and ages as for numbers at length."""
    write_result(df, folder, name, fmt, partition_by)
    return read_result(df.sparkSession, folder, name, dict(df.dtypes), fmt)


def read_result(spark: SparkSession, folder: str, name: str, schema: dict[str, str], fmt: str = "csv") -> DataFrame:
    return typed(scan(spark, current_path(spark, folder, name, fmt), fmt), schema)
