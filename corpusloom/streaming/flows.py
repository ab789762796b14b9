"""The batch transformations on streams of files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from corpusloom.operators.tables import delete_folder, last_wins, names_in, read_table, upsert_table
from corpusloom.staging import fresh_path

Step = Callable[[DataFrame], DataFrame]


def file_stream(spark: SparkSession, folder: str, schema, glob: str = "*.parquet", files_per_trigger: int = 1000) -> DataFrame:
    """New Parquet files of a folder, a bounded number per micro-batch."""
    return (
        spark.readStream.schema(schema)
        .option("maxFilesPerTrigger", files_per_trigger)
        .option("pathGlobFilter", glob)
        .parquet(folder)
    )


def to_files(stream: DataFrame, step: Step, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Apply a row-wise step and append the result; restarts continue from the checkpoint."""
    writer = step(stream).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    if once:
        writer = writer.trigger(availableNow=True)
    return writer.outputMode("append").start()


def to_upserts(stream: DataFrame, path: str, key: str, version: list[str], checkpoint: str, once: bool = True) -> StreamingQuery:
    """Upsert each micro-batch at the cost of the batch, not of the table.

    A batch keeps its newest row per key and goes to a folder of its own, named by its number;
    a repeated batch replaces its folder, so restarts are safe. ``current_rows`` resolves the
    folders; ``compact``, called from time to time, merges them into a table.
    """

    def write(batch: DataFrame, number: int) -> None:
        newest = last_wins(batch, key, version)
        newest.write.mode("overwrite").parquet(f"{path}/batch_no={number}")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    if once:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def _batches(spark: SparkSession, path: str) -> list[str]:
    return [f"{path}/{name}" for name in names_in(spark, path) if name.startswith("batch_no=")]


def current_rows(
    spark: SparkSession, path: str, key: str, version: list[str], table: str | None = None
) -> DataFrame:
    """The newest row of every key: of the latest batch, then of the highest version. ``table``
    is where ``compact`` puts the batches it merges."""
    stored = None if table is None else read_table(spark, table)
    folders = _batches(spark, path)
    rows = spark.read.option("basePath", path).parquet(*folders) if folders or stored is None else None
    if rows is not None and stored is not None:
        rows = rows.unionByName(stored)
    return last_wins(stored if rows is None else rows, key, ["batch_no", *version]).drop("batch_no")


def compact(spark: SparkSession, path: str, table: str, key: str, version: list[str]) -> int:
    """Merge the batch folders present into ``table`` and delete them; returns their number.

    Call it while no stream writes to ``path``. If it stops half-way the folders stay and are
    merged again, which changes nothing.
    """
    folders = _batches(spark, path)
    if folders:
        rows = spark.read.option("basePath", path).parquet(*folders)
        upsert_table(spark, table, rows, key, ["batch_no", *version])
        for folder in folders:
            delete_folder(spark, folder)
    return len(folders)


def replay(spark: SparkSession, folder: str, schema, step: Step, glob: str = "*.parquet") -> DataFrame:
    """Run all files present through the streaming form of a step and return what was written."""
    out, state = fresh_path(spark, "stream-out"), fresh_path(spark, "stream-state")
    query = to_files(file_stream(spark, folder, schema, glob), step, out, state)
    query.awaitTermination()
    return spark.read.parquet(out)
