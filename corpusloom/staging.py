"""Tables written once so that later steps read the same rows.

Positions that depend on where a row landed (range partitions, file splits) must not be
recomputed by a second job: a lost executor or a changed split size would move them. Such
intermediate results are written to the shared folder of ``spark.checkpoint.dir`` and read back.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Spark's setting that removes the shuffle files of an action when it ends.
_FILE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_local_roots: dict[str, str] = {}
_written: list[str] = []


def staging_root(spark: SparkSession) -> str:
    """The shared folder the session names; only a local session may fall back to its own."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local_roots:
        _local_roots[app] = tempfile.mkdtemp(prefix="run-corpusloom-", dir="/tmp")
    return _local_roots[app]


def fresh_path(spark: SparkSession, tag: str) -> str:
    path = f"{staging_root(spark)}/{tag}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """For writes of tables that are read back: the shuffle files of a write go when it ends. Spark
    else keeps them until the driver's garbage is collected, and the disk holds those of all steps.
    Another action of the session that begins meanwhile loses its files at its end, too, and would
    compute them again."""
    before = spark.conf.get(_FILE_CLEANUP, None)
    spark.conf.set(_FILE_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_FILE_CLEANUP) if before is None else spark.conf.set(_FILE_CLEANUP, before)


def stage(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and return it as a table scan."""
    path = fresh_path(df.sparkSession, tag)
    with shuffles_removed(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_enough(df: DataFrame, max_rows: int) -> bool:
    """True if ``df`` has at most ``max_rows`` rows; reads no more than one row beyond."""
    return df.limit(max_rows + 1).count() <= max_rows


def hinted(df: DataFrame, max_rows: int) -> DataFrame:
    """``df`` marked for broadcast if it is small enough, else as it is. Counts ``df``: pass a
    stored table or something as cheap."""
    return F.broadcast(df) if small_enough(df, max_rows) else df


def clear(spark: SparkSession) -> None:
    """Delete what this process has staged; results still based on it become unreadable."""
    jvm = spark.sparkContext._jvm
    configuration = spark.sparkContext._jsc.hadoopConfiguration()
    while _written:
        path = jvm.org.apache.hadoop.fs.Path(_written.pop())
        path.getFileSystem(configuration).delete(path, True)
