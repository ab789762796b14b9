"""A table with one row per key, stored in buckets, so that an upsert costs what it touches.

A row's bucket is the hash of its key. A version of the table is a small manifest that names, for
every bucket, the folder that holds its rows. An upsert reads and writes only the buckets its batch
falls into and leaves the folders of the others where they are. It counts from the moment its
manifest exists: the manifest is written under a name of its own and then linked to the next number,
which succeeds for one writer only. A writer that comes second reads the new version; where the
buckets differ its rows still hold, otherwise it merges again.

    create(spark, path, "id bigint, content string", key="id")
    upsert(spark, path, batch, version=["v"])
    read(spark, path)

Null keys are keys of their own. The folder has to be one that driver and executors share; besides
local paths that is any file system whose rename fails if the target exists.
"""

from __future__ import annotations

import json
import os
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators.tables import _files, delete_folder, last_wins, names_in
from corpusloom.operators.tables import upsert as merged_rows

BUCKETS = 64
ATTEMPTS = 20


@dataclass
class Version:
    """Manifest ``number``: key, schema (DDL), number of buckets, folder of each filled bucket."""

    number: int
    key: str
    schema: str
    buckets: int
    folders: dict[int, str] = field(default_factory=dict)

    def to_json(self) -> str:
        return json.dumps({**vars(self), "folders": {str(b): f for b, f in self.folders.items()}})

    @classmethod
    def of(cls, text: str) -> Version:
        values = json.loads(text)
        return cls(**{**values, "folders": {int(b): f for b, f in values["folders"].items()}})


class VersionTaken(Exception):
    """Another writer has the number."""


def _manifest(path: str, number: int) -> str:
    return f"{path}/manifests/{number:012d}.json"


def current(spark: SparkSession, path: str) -> Version:
    found = [n for n in names_in(spark, f"{path}/manifests") if n.endswith(".json")]
    if not found:
        raise FileNotFoundError(f"no table at {path}")
    text = spark.read.text(f"{path}/manifests/{found[-1]}", wholetext=True).first()[0]
    return Version.of(text)


def _claim(spark: SparkSession, path: str, version: Version) -> None:
    """Make the manifest the one of its number, or raise VersionTaken."""
    target, files = _files(spark, _manifest(path, version.number))
    source, _ = _files(spark, f"{path}/manifests/_{uuid.uuid4().hex}")
    out = files.create(source, False)
    out.write(version.to_json().encode())
    out.close()
    try:
        if files.getScheme() == "file":
            # a local rename would replace the target; a link does not
            os.link(source.toUri().getPath(), target.toUri().getPath())
        elif files.exists(target) or not files.rename(source, target):
            raise VersionTaken(version.number)
    except FileExistsError:
        raise VersionTaken(version.number) from None
    finally:
        files.delete(source, False)


def create(spark: SparkSession, path: str, schema: str, key: str, buckets: int = BUCKETS) -> None:
    """An empty table; VersionTaken if there is one."""
    _, files = _files(spark, path)
    files.mkdirs(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/manifests"))
    _claim(spark, path, Version(0, key, schema, buckets))


def bucket_of(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def _rows(spark: SparkSession, version: Version, buckets: list[int] | None = None) -> DataFrame:
    folders = [f for b, f in version.folders.items() if buckets is None or b in buckets]
    if not folders:
        return spark.createDataFrame([], version.schema)
    return spark.read.schema(version.schema).parquet(*folders)


def read(spark: SparkSession, path: str) -> DataFrame:
    return _rows(spark, current(spark, path))


def read_keys(spark: SparkSession, path: str, keys: DataFrame) -> DataFrame:
    """The rows of the keys in ``keys``, from their buckets only."""
    version = current(spark, path)
    touched = [r[0] for r in keys.select(bucket_of(version.key, version.buckets)).distinct().collect()]
    rows, wanted = _rows(spark, version, touched), keys.select(F.col(version.key).alias("_wanted")).distinct()
    return rows.join(wanted, rows[version.key].eqNullSafe(wanted["_wanted"]), "left_semi")


def _write_buckets(spark: SparkSession, path: str, version: Version, batch: DataFrame, order: list[str], touched: list[int]) -> dict[int, str]:
    """Merge the batch into its buckets, in a folder of this attempt; returns where they are."""
    old = _rows(spark, version, touched)
    columns = old.columns
    extra = [c for c in batch.columns if c not in columns]
    padded = old.select("*", *[F.lit(None).cast(batch.schema[c].dataType).alias(c) for c in extra])
    rows = merged_rows(padded, batch, version.key, order).select(*columns)
    folder = f"{path}/data/{uuid.uuid4().hex}"
    numbered = rows.withColumn("_bucket", bucket_of(version.key, version.buckets))
    numbered.repartition(len(touched), "_bucket").write.partitionBy("_bucket").parquet(folder)
    return {b: f"{folder}/_bucket={b}" for b in touched}


def upsert(spark: SparkSession, path: str, batch: DataFrame, version: list[str]) -> Version:
    """Rows of ``batch`` replace those of the same key; of several in the batch the one of the
    highest ``version`` columns stays. These need not be columns of the table."""
    base = current(spark, path)
    touched = sorted(r[0] for r in batch.select(bucket_of(base.key, base.buckets)).distinct().collect())  # at most base.buckets
    if not touched:
        return base
    written = _write_buckets(spark, path, base, batch, version, touched)
    newest = base
    for _ in range(ATTEMPTS):
        if any(newest.folders.get(b) != base.folders.get(b) for b in touched):
            base = newest
            written = _write_buckets(spark, path, base, batch, version, touched)
        made = Version(newest.number + 1, base.key, base.schema, base.buckets, {**newest.folders, **written})
        try:
            _claim(spark, path, made)
            return made
        except VersionTaken:
            newest = current(spark, path)
    raise VersionTaken(f"{ATTEMPTS} versions came in between")


def drop_old_data(spark: SparkSession, path: str) -> None:
    """Delete what the current version does not use; call it when no reader or writer is at work."""
    used = {f.rsplit("/", 1)[0].rsplit("/", 1)[1]: set() for f in current(spark, path).folders.values()}
    for folder in current(spark, path).folders.values():
        used[folder.rsplit("/", 2)[1]].add(folder.rsplit("/", 1)[1])
    for name in names_in(spark, f"{path}/data"):
        if name not in used:
            delete_folder(spark, f"{path}/data/{name}")
            continue
        for bucket in names_in(spark, f"{path}/data/{name}"):
            if bucket.startswith("_bucket=") and bucket not in used[name]:
                delete_folder(spark, f"{path}/data/{name}/{bucket}")
    for name in names_in(spark, f"{path}/manifests")[:-1]:
        delete_folder(spark, f"{path}/manifests/{name}")
