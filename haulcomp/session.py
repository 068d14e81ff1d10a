"""Session settings for local use, and the shared folder for staged tables."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "haulcomp", cores: int | str = "*", partitions: int = 8) -> SparkSession:
    """A local session for tests and the bench; on a cluster bring your own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_own_dir: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see: spark.checkpoint.dir; a local master may do without and gets a temporary one."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors see")
    if not _own_dir:
        _own_dir.append(tempfile.mkdtemp(prefix="haulcomp-"))
        atexit.register(shutil.rmtree, _own_dir[0], ignore_errors=True)
    return _own_dir[0]


#: A written table is read from its files, so what was shuffled for it goes when it is written, and not when the driver collects its garbage.
DROP_SHUFFLES = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
#: What is partitioned by some of the keys of a join meets what is partitioned alike; neither is shuffled again.
PART_OF_KEYS = {"spark.sql.requireAllClusterKeysForCoPartition": "false"}


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Session settings for what is planned inside."""
    before = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write a frame that several branches read to the shared folder and read it back.

    Cuts the lineage durably: the table outlives the executors that wrote it.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    with settings(spark, DROP_SHUFFLES):
        df.write.parquet(path)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


_written: list[str] = []


@contextmanager
def staging(spark: SparkSession) -> Iterator[None]:
    """Remove on leaving what was staged inside; write or collect results before."""
    start = len(_written)
    try:
        yield
    finally:
        done = _written[start:]
        del _written[start:]
        for key in [k for k, df in _staged.items() if any(p.rpartition("/")[2] in "".join(df.inputFiles()[:1]) for p in done)]:
            del _staged[key]
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        for path in done:
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(conf).delete(where, True)


_staged: dict[tuple[str, str], DataFrame] = {}


def staged_once(spark: SparkSession, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """``stage`` of a frame many callers start from: written once per application under its name."""
    key = (spark.sparkContext.applicationId, name)
    if key not in _staged:
        _staged[key] = stage(build(), re.sub(r"[^A-Za-z0-9.]+", "-", name).strip("-"))
    return _staged[key]
