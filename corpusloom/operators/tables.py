"""Chunk tables: validation, row building, upsert, create-if-missing and counting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.text import strip

# Fixed value: fields every flat chunk must have.
REQUIRED_FIELDS = ("char_count", "content", "doc_id", "label", "page", "source", "token_count")


def missing_fields(json: Column) -> Column:
    """Required keys absent from a JSON object, sorted."""
    keys = F.coalesce(F.json_object_keys(json), F.array().cast("array<string>"))
    return F.array_except(F.array(*[F.lit(f) for f in REQUIRED_FIELDS]), keys)


def validation_error(json: Column) -> Column:
    """Null for a valid chunk, else what is wrong with it."""
    content = F.get_json_object(json, "$.content")
    # a string may start with any of these characters, so objects are told by their keys
    not_object = F.json_object_keys(json).isNull()
    missing = F.array_join(missing_fields(json), ", ")
    return (
        F.when(not_object, "not an object")
        .when(missing != "", F.concat(F.lit("missing: "), missing))
        .when(content.isNull() | (strip(content) == ""), "empty content")
    )


def split_valid(df: DataFrame, json: str) -> tuple[DataFrame, DataFrame]:
    """Good rows, and bad rows with their ``error``."""
    checked = df.withColumn("error", validation_error(F.col(json)))
    return checked.where("error IS NULL").drop("error"), checked.where("error IS NOT NULL")


def vector_rows(chunks: DataFrame) -> DataFrame:
    """Rows of the structural collection with their defaults for missing values."""
    return chunks.select(
        F.coalesce("chunk_id", F.lit("")).alias("chunk_id"),
        "text",
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"),
        F.coalesce("page_index", F.lit(0)).cast("bigint").alias("page_index"),
        F.coalesce("chunk_type", F.lit("text")).alias("chunk_type"),
        F.coalesce("title", F.lit("")).alias("title"),
        *(["embedding"] if "embedding" in chunks.columns else []),
    )


def last_wins(df: DataFrame, key: str, version: list[str]) -> DataFrame:
    """One row per key: the one of highest version, of equal versions the one whose columns are
    largest in the order of their hash. Tasks keep one row per key before the shuffle, so a key
    with very many copies costs no more than others."""
    rest = [c for c in df.columns if c != key]
    newest = F.max_by(F.struct(*rest), F.struct(*version, F.xxhash64(*rest).alias("_tie"))).alias("_row")
    return df.groupBy(key).agg(newest).select(key, "_row.*").select(*df.columns)


def upsert(target: DataFrame, batch: DataFrame, key: str, version: list[str]) -> DataFrame:
    """Batch rows replace target rows of the same key; within the batch the last one wins."""
    tagged = target.withColumn("_fresh", F.lit(0)).unionByName(batch.withColumn("_fresh", F.lit(1)))
    return last_wins(tagged, key, ["_fresh", *version]).drop("_fresh")


def _files(spark: SparkSession, path: str):
    """The Hadoop path and its file system."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def names_in(spark: SparkSession, path: str) -> list[str]:
    """Names directly under a folder, sorted; none if it does not exist."""
    place, files = _files(spark, path)
    return sorted(f.getPath().getName() for f in files.listStatus(place)) if files.exists(place) else []


def delete_folder(spark: SparkSession, path: str) -> None:
    place, files = _files(spark, path)
    files.delete(place, True)


def _versions(spark: SparkSession, path: str) -> list[str]:
    """Complete versions that upserts have written, oldest first."""
    folders = [f"{path}/_versions/{name}" for name in names_in(spark, f"{path}/_versions")]
    return [f for f in folders if "_SUCCESS" in names_in(spark, f)]


def current_folder(spark: SparkSession, path: str) -> str:
    """Where the rows of the table are: its last complete version, or the folder itself."""
    return (_versions(spark, path) or [path])[-1]


def read_table(spark: SparkSession, path: str) -> DataFrame | None:
    """The table at ``path``, or None if nothing is there. A folder that cannot be read fails."""
    place, files = _files(spark, path)
    return spark.read.parquet(current_folder(spark, path)) if files.exists(place) else None


def ensure_table(spark: SparkSession, path: str, schema: str, drop: bool = False) -> None:
    """Create an empty table if missing (or after dropping the old content)."""
    if drop:
        spark.createDataFrame([], schema).write.mode("overwrite").parquet(path)
    elif read_table(spark, path) is None:
        spark.createDataFrame([], schema).write.mode("errorifexists").parquet(path)


def upsert_table(spark: SparkSession, path: str, batch: DataFrame, key: str, version: list[str]) -> None:
    """Upsert into a stored table.

    The merged rows become a new numbered version beside the old ones and count from the moment
    they are complete: readers see the old table or the new one, and a failed write changes
    nothing. Two writers at once cannot take the same number; the second fails.
    """
    current = read_table(spark, path)
    merged = last_wins(batch, key, version) if current is None else upsert(current, batch, key, version)
    done = _versions(spark, path)
    number = int(done[-1].rsplit("-", 1)[1]) + 1 if done else 1
    target = f"{path}/_versions/v-{number:09d}"
    if target.rsplit("/", 1)[1] in names_in(spark, f"{path}/_versions"):
        delete_folder(spark, target)  # left by a write that failed
    merged.write.mode("errorifexists").parquet(target)


def drop_old_versions(spark: SparkSession, path: str) -> None:
    """Delete all versions but the current one; call it when no reader uses them any more."""
    for folder in _versions(spark, path)[:-1]:
        delete_folder(spark, folder)


def ingest(rows: DataFrame, path: str, drop_existing: bool = True) -> int:
    """Write rows, replacing or appending; returns how many were written, counted on the way."""
    seen = Observation("ingest")
    watched = rows.observe(seen, F.count(F.lit(1)).alias("n"))
    if drop_existing:
        watched.write.mode("overwrite").parquet(path)
    else:
        watched.write.mode("append").parquet(current_folder(rows.sparkSession, path))
    return seen.get["n"]


def table_count(spark: SparkSession, path: str) -> int:
    table = read_table(spark, path)
    return 0 if table is None else table.count()
