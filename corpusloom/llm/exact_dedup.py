"""Exact deduplication by a stream with keyed state on disk.

Documents arrive as narrow rows: the digest of the text, the stable identifier, and the content
locator (the file and the row number given when the arrival was stored). A streaming aggregation
keeps one state entry per digest, without expiry, in the disk-backed state store: how many rows
came, and the identifier and locator of the row that stays. Copies are merged in each task before
they reach the state, so a text that a third of all rows share is a few rows per task. A digest
that was hit more than once is then checked on the full bytes: equal digests of different texts
are taken apart.

Defined cases: a null text counts as empty; texts are compared unchanged; of equal texts the row
with the largest identifier stays, a null identifier being the smallest; of repeated rows (same
identifier, same text) exactly one stays; an empty table gives an empty result; other columns are
ignored, also those named as the columns made here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import attach, free_name, fresh_path, plain_text, stage, union
from corpusloom.staging import hinted

STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    # Many small stores: no disk space is to be set aside in advance for each.
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}
#: Narrow rows that one partition of the state is meant for.
STATE_ROWS = 1_000_000
#: Bound of the broadcast table that tells which texts may have a hit digest.
SLOTS = 1 << 20
#: Rows to drop, 40 bytes each, that keep_one broadcasts at most.
DROPPED = 1_000_000


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def store_arrivals(docs: DataFrame, digest=sha256) -> str:
    """Write the narrow row of each document to the shared folder; returns that folder."""
    folder = fresh_path(docs.sparkSession, "arrivals")
    docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        digest(plain_text()).alias("digest"),
        F.input_file_name().alias("file"),
        F.monotonically_increasing_id().alias("place"),
    ).write.parquet(folder)
    return folder


def stream_state(spark, arrivals: str, checkpoint: str, partitions: int, bytes_per_batch: int = 64 << 30) -> DataFrame:
    """Take in what is new in ``arrivals`` and return the state: one row per digest.

    A later call with the same checkpoint reads only files that came since; the first one fixes
    the number of partitions. Micro-batches are bounded by ``bytes_per_batch`` of narrow rows.
    """
    session = spark.newSession()
    for key, value in {**STATE_STORE, "spark.sql.shuffle.partitions": str(partitions)}.items():
        session.conf.set(key, value)
    schema = spark.read.parquet(arrivals).schema
    query = (
        session.readStream.schema(schema)
        .option("maxBytesPerTrigger", str(bytes_per_batch))
        .parquet(arrivals)
        .groupBy("digest")
        .agg(F.count("*").alias("n"), F.max(F.struct("doc_id", "place", "file")).alias("keep"))
        .writeStream.format("noop")
        .outputMode("update")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    state = spark.read.format("statestore").load(checkpoint)
    count, keep = state.schema["value"].dataType.names
    return state.select(
        F.col("key.digest").alias("digest"), F.col(f"value.{count}").alias("n"), F.col(f"value.{keep}").alias("keep")
    )


def collided(docs: DataFrame, hits: DataFrame, total: int, digest=sha256) -> DataFrame:
    """Digests of ``hits`` under which the full bytes of the texts differ.

    The texts behind hit digests are fetched again and merged by their bytes, in each task first.
    A broadcast table of at most SLOTS hash slots of hit digests keeps most other texts from being
    shuffled; it only spares work, the join on the digest decides.
    """
    slot = F.pmod(F.xxhash64("digest"), F.lit(SLOTS))
    slots = F.broadcast(hits.select(slot.alias("slot")).distinct())
    texts = docs.select(plain_text().alias("text")).withColumn("digest", digest(F.col("text")))
    texts = texts.withColumn("slot", slot).join(slots, "slot", "left_semi").drop("slot")
    found = attach(texts, hits.select("digest", "n"), ["digest"], "n", total, "left_semi")
    classes = found.groupBy("digest", "text").agg(F.count("*").alias("n"))
    return classes.groupBy("digest").agg(F.count("*").alias("texts")).filter("texts > 1").select("digest")


def deduplicate(docs: DataFrame, digest=sha256) -> DataFrame:
    """One row per row of ``docs`` (columns ``doc_id``, ``text``).

    Columns: doc_id, digest, keep_id, group_size, kept, keep_file (where the text that stays is).
    """
    spark = docs.sparkSession
    arrivals = store_arrivals(docs, digest)
    rows = spark.read.parquet(arrivals)
    total = rows.count()
    if total:
        partitions = max(8, min(total // STATE_ROWS, int(spark.conf.get("spark.sql.shuffle.partitions"))))
        state = stream_state(spark, arrivals, fresh_path(spark, "dedup-state"), partitions)
        groups = stage(state.filter("n > 1"), "dedup-groups")
    else:
        groups = rows.select("digest", F.lit(0).cast("long").alias("n"), F.struct("doc_id", "place", "file").alias("keep"))
    differing = stage(collided(docs, groups, total, digest), "dedup-collisions")
    parts = [rows]
    if not differing.isEmpty():
        parts = [rows.join(differing, "digest", "left_anti")]
    decided = attach(parts[0], groups, ["digest"], "n", total).select(
        "doc_id",
        "digest",
        F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("keep.doc_id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("place") == F.col("keep.place"), F.lit(True)).alias("kept"),
        F.coalesce("keep.file", "file").alias("keep_file"),
    )
    if len(parts) == 1 and parts[0] is rows:
        return decided
    return union([decided, _by_bytes(docs, differing, digest)])


def _by_bytes(docs: DataFrame, differing: DataFrame, digest) -> DataFrame:
    """The decision for digests that different texts share, on the texts themselves."""
    texts = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        plain_text().alias("text"),
        F.input_file_name().alias("file"),
        F.monotonically_increasing_id().alias("place"),
    ).withColumn("digest", digest(F.col("text")))
    texts = stage(texts.join(differing, "digest", "left_semi"), "dedup-collided")
    classes = stage(
        texts.groupBy("digest", "text").agg(
            F.count("*").alias("n"), F.max(F.struct("doc_id", "place", "file")).alias("keep")
        ),
        "dedup-classes",
    )
    return attach(texts, classes, ["digest", "text"], "n", texts.count()).select(
        "doc_id",
        "digest",
        F.col("keep.doc_id").alias("keep_id"),
        F.col("n").alias("group_size"),
        (F.col("place") == F.col("keep.place")).alias("kept"),
        F.col("keep.file").alias("keep_file"),
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, all columns as they are. Only rows of texts that repeat are
    looked for; up to DROPPED of them are broadcast, so that the texts need not move."""
    decided = deduplicate(docs).filter("group_size > 1").groupBy(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest"))
    decided = decided.agg(F.max("kept").alias("_kept"), F.count("*").alias("_n")).filter("NOT _kept OR _n > 1")
    decided = stage(decided, "dedup-decided")
    key, text_digest = free_name(docs, "_key"), free_name(docs, "_text_digest")
    named = docs.withColumns({key: F.col("doc_id").cast("long"), text_digest: sha256(plain_text())})

    def those(found: DataFrame, how: str) -> DataFrame:
        found = hinted(found, DROPPED)
        return named.join(found, named[key].eqNullSafe(found["_id"]) & (named[text_digest] == found["_digest"]), how)

    rows = those(decided, "left_anti")
    # Rows that agree in identifier and text are told apart by nothing: any one of them stays.
    repeated = decided.filter("_kept")
    if not repeated.isEmpty():
        rows = rows.unionByName(those(repeated, "left_semi").dropDuplicates([key, text_digest]))
    return rows.drop(key, text_digest)
