"""Web pages as WARC archives: written in shards by executors, committed, read back and verified.

Planning works on narrow rows (identifier, digest, size). Records are ordered by a key of identifier
and digest and cut into shards of about equal payload at keys that depend on the data alone, not on
the cluster. A page and what was decided about it travel to the task of its shard as two rows that
the sort puts side by side, so the payload moves once and no join holds it. The task streams through
the sorted rows, writes a gzip member per record with headers and digests made anew, and starts the
next file of the shard at a compressed size. Files get temporary names that no other attempt shares;
the rows of those attempts that count are the manifest. Only files of the manifest are renamed, the
rest is deleted, and the stored manifest comes last: a folder without it is no archive.

Of records with equal payloads of at least ``least`` bytes the one with the largest identifier is the
response and the others revisit it; smaller ones are all responses. Payloads are taken as equal when
SHA-256 and length are.

Defined cases: a null html is an empty payload; a null url gives a record without target; control
characters, blanks and percent signs of a url are percent-encoded in the header; a null identifier is
the smallest and its record has none; of rows that repeat an identifier with its payload one (the
largest url) is the response, the others revisit it, and such rows stay in one shard; empty and very
long payloads are written whole; an empty table gives an archive without files; other columns are
ignored, also those named as the columns made here.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from bisect import bisect_right
from collections import deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import attach, fresh_path, plain_text, stage
from corpusloom.operators.ordering import running_totals

# Fixed values of the format.
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = b"\r\n\r\n"

NAMESPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:pages")
DATE = "1970-01-01T00:00:00Z"
LEAST = 1000
#: Payload bytes meant for a shard, and the bound of the number of shards; one key a shard is broadcast.
SHARD_BYTES, MOST_SHARDS = 32 << 20, 100_000
#: Compressed size at which a file is closed.
FILE_BYTES = 8 << 20
#: What a record counts besides its payload.
RECORD_BYTES = 400

MANIFEST = "name string, shard long, records long, bytes long, sha1 string"


@dataclass(frozen=True)
class Archive:
    """A committed archive: the folder of its files, and where its manifest is stored."""

    files: str
    manifest: str


# -- planning -------------------------------------------------------------------------------


def _keyed(pages: DataFrame) -> DataFrame:
    """page_id, url, payload and the key: identifier (null first, then by value) and digest as bytes."""
    number = F.col("page_id").cast("long")
    # Two's complement with the sign turned round sorts as bytes.
    turned = F.unhex(F.lpad(F.hex(number.bitwiseXOR(F.lit(-(1 << 63)))), 16, "0"))
    payload = F.encode(plain_text("html"), "utf-8")
    prefix = F.when(number.isNull(), F.lit(b"\0")).otherwise(F.concat(F.lit(b"\1"), turned))
    return pages.select(
        number.alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"),
        F.unhex(F.sha2(payload, 256)).alias("sha256"),
    ).withColumn("key", F.concat(prefix, "sha256"))


def plan(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """A stored row per page: key, size, and for revisits the response (page_id, url, sha256)."""
    narrow = _keyed(pages).select("page_id", "url", "sha256", "key", F.octet_length("payload").cast("long").alias("size"))
    rows = stage(narrow.withColumn("row", F.monotonically_increasing_id()), "warc-rows")
    alike = rows.where(F.col("size") >= least).groupBy("sha256", "size").agg(
        F.count("*").alias("n"), F.max(F.struct("page_id", "url", "row")).alias("best")
    )
    repeated = stage(alike.where("n > 1"), "warc-repeats")
    decided = attach(rows, repeated, ["sha256", "size"], "n", rows.count())
    response = F.struct(F.col("best.page_id"), F.col("best.url"), F.col("sha256"))
    return stage(
        decided.select("key", "size", "row", F.when(F.col("best.row") != F.col("row"), response).alias("response")), "warc-plan"
    )


def shard_starts(planned: DataFrame, shard_bytes: int = SHARD_BYTES) -> list[bytes]:
    """The first key of every shard but the first, in order."""
    # Pages that will be revisits count in full: their payload moves to the shard as well.
    costs = planned.select("key", "row", (F.col("size") + RECORD_BYTES).alias("cost"))
    total = costs.agg(F.sum("cost")).first()[0] or 0
    width = max(shard_bytes, -(-total // MOST_SHARDS))
    upto = running_totals(costs, ["key", "row"], {"upto": "cost"})
    shard = F.floor((F.col("upto") - F.col("cost")) / width)
    starts = upto.groupBy(shard.alias("shard")).agg(F.min("key").alias("key")).where("shard > 0").select("key").distinct()
    return sorted(bytes(r.key) for r in starts.collect())  # at most MOST_SHARDS


def shard_of(spark: SparkSession, starts: list[bytes]) -> Callable[[Column], Column]:
    shared = spark.sparkContext.broadcast(starts)

    @F.pandas_udf("long")
    def find(keys: pd.Series) -> pd.Series:
        return keys.map(lambda key: bisect_right(shared.value, bytes(key))).astype("int64")

    return find


# -- records --------------------------------------------------------------------------------


def _sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id: int | None, url: str | None, sha256: bytes, copy: int = 0) -> str:
    """The same page gets the same identifier in every run; ``copy`` numbers repeated rows."""
    told = "|".join(["" if page_id is None else str(page_id), sha256.hex(), str(copy), url or ""])
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, told)}>"


def _target(url: str) -> str:
    return "".join(quote(c) if c <= " " or c in "%\x7f" else c for c in url)


def record(page_id, url, sha256: bytes, payload: bytes, response: dict | None, copy: int) -> bytes:
    """One response, or a revisit of ``response`` (page_id, url, sha256), without compression."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if response else http + payload
    fields = [
        ("WARC-Type", "revisit" if response else "response"),
        ("WARC-Record-ID", record_id(page_id, url, sha256, copy)),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", None if url is None else _target(url)),
        ("WARC-Payload-Digest", _sha1(payload)),
        ("WARC-Block-Digest", _sha1(block)),
        ("WARC-Page-ID", page_id),
    ]
    if response:
        fields += [
            ("WARC-Profile", REVISIT_PROFILE),
            ("WARC-Refers-To", record_id(response["page_id"], response["url"], response["sha256"])),
            ("WARC-Refers-To-Target-URI", None if response["url"] is None else _target(response["url"])),
            ("WARC-Refers-To-Page-ID", response["page_id"]),
        ]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", len(block))]
    head = "".join(f"{name}: {value}\r\n" for name, value in fields if value is not None)
    return f"{VERSION}\r\n{head}\r\n".encode() + block + END


def member(data: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)  # a gzip member without name and time
    return packer.compress(data) + packer.flush()


def members(data: bytes) -> Iterator[bytes]:
    """The contents of the gzip members of a file."""
    view, at = memoryview(data), 0
    while at < len(view):
        unpacker, out = zlib.decompressobj(31), []
        while not unpacker.eof:
            piece = view[at : at + 65536]
            if not len(piece):
                raise ValueError("torn gzip member")
            out.append(unpacker.decompress(piece))
            at += len(piece) - len(unpacker.unused_data)
        yield b"".join(out)


def parse(data: bytes) -> dict:
    """Fields of one record and its payload; digests and lengths are checked."""
    head, _, rest = data.partition(END)
    version, *lines = head.decode().split("\r\n")
    fields = dict(line.split(": ", 1) for line in lines)
    block = rest[: int(fields["Content-Length"])]
    if version != VERSION or rest[len(block) :] != END or _sha1(block) != fields["WARC-Block-Digest"]:
        raise ValueError(f"damaged record {fields.get('WARC-Record-ID')}")
    http, _, payload = block.partition(END)
    size = int(dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])["Content-Length"])
    kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"]
    if kind == "response" and (len(payload) != size or _sha1(payload) != digest):
        raise ValueError(f"damaged payload of {fields['WARC-Record-ID']}")
    number = lambda name: int(fields[name]) if name in fields else None
    return {
        "page_id": number("WARC-Page-ID"),
        "url": unquote(fields["WARC-Target-URI"]) if "WARC-Target-URI" in fields else None,
        "record_id": fields["WARC-Record-ID"],
        "record_type": kind,
        "payload_bytes": size,
        "payload_digest": base64.b32decode(digest.removeprefix("sha1:")).hex(),
        "refers_to": number("WARC-Refers-To-Page-ID"),
        "payload": payload if kind == "response" else None,
    }


# -- writing --------------------------------------------------------------------------------


class _ShardFiles:
    """The files of the shards of one task attempt, under names of its own."""

    def __init__(self, folder: str, file_bytes: int):
        self.system, self.root = fs.FileSystem.from_uri(folder)
        self.file_bytes, self.attempt = file_bytes, uuid.uuid4().hex
        self.system.create_dir(f"{self.root}/temporary", recursive=True)
        self.shard, self.number, self.out, self.done = None, 0, None, []

    def add(self, shard: int, data: bytes) -> None:
        if shard != self.shard:
            self.close()
            self.shard, self.number = shard, 0
        elif self.out and self.bytes >= self.file_bytes:
            self.close()
            self.number += 1
        if not self.out:
            self.name = f"pages-{shard:06d}-{self.number:05d}.warc.gz"
            self.out = self.system.open_output_stream(f"{self.root}/temporary/{self.attempt}-{self.name}", compression=None)
            self.bytes, self.records, self.digest = 0, 0, hashlib.sha1()
        self.out.write(data)
        self.digest.update(data)
        self.bytes, self.records = self.bytes + len(data), self.records + 1

    def close(self) -> None:
        if self.out:
            self.out.close()
            row = (self.name, self.shard, self.records, self.bytes, self.digest.hexdigest())
            self.done.append((*row, f"{self.attempt}-{self.name}"))
            self.out = None


def _shard_writer(folder: str, file_bytes: int):
    """Rows of whole shards, sorted: decisions of a key, then its pages. Yields a row per file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, key, decisions, copy = None, None, deque(), 0
        for batch in batches:
            files = files or _ShardFiles(folder, file_bytes)
            columns = [batch.column(name) for name in ("shard", "key", "page", "response", "page_id", "url", "payload")]
            for i in range(batch.num_rows):
                shard, this, is_page, response, page_id, url, payload = (c[i].as_py() for c in columns)
                if this != key:
                    if decisions:
                        raise ValueError("a decision without its page")
                    key, copy = this, 0
                if not is_page:
                    decisions.append(response)
                    continue
                data = record(page_id, url, key[-32:], payload, decisions.popleft(), copy)
                files.add(shard, member(data))
                copy += 1
        if files:
            files.close()
            names = ["name", "shard", "records", "bytes", "sha1", "temporary"]
            yield pa.record_batch([pa.array(c) for c in zip(*files.done)], names=names)

    return run


def _renamer(folder: str):
    """Give the files their names; a repeated task finds those of its first attempt in place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = fs.FileSystem.from_uri(folder)
        system.create_dir(f"{root}/files", recursive=True)
        for batch in batches:
            for row in batch.to_pylist():
                source, target = f"{root}/temporary/{row['temporary']}", f"{root}/files/{row['name']}"
                if system.get_file_info(source).type != fs.FileType.NotFound:
                    system.move(source, target)
                found = system.get_file_info(target)
                if found.size != row["bytes"]:
                    raise ValueError(f"{target}: {found.size} bytes, {row['bytes']} in the manifest")
            yield batch.select(["name", "shard", "records", "bytes", "sha1"])

    return run


def write(pages: DataFrame, folder: str | None = None, least: int = LEAST, shard_bytes: int = SHARD_BYTES, file_bytes: int = FILE_BYTES) -> Archive:
    """Write ``pages`` (page_id, url, html) to ``folder``, a new one that all executors share."""
    spark = pages.sparkSession
    folder = folder or fresh_path(spark, "warc")
    planned = plan(pages, least)
    starts = shard_starts(planned, shard_bytes)
    shard = shard_of(spark, starts)("key").alias("shard")
    none = {"response": planned.schema["response"].dataType, "page_id": "long", "url": "string", "payload": "binary"}
    decisions = planned.select(
        shard, "key", F.lit(False).alias("page"), "response", *[F.lit(None).cast(none[c]).alias(c) for c in ("page_id", "url", "payload")]
    )
    records = _keyed(pages).select(
        shard, "key", F.lit(True).alias("page"), F.lit(None).cast(none["response"]).alias("response"), "page_id", "url", "payload"
    )
    # Of a key first the response, which is the page with the largest url.
    order = ["shard", "key", "page", F.col("response").isNotNull(), F.col("url").desc_nulls_last()]
    rows = decisions.unionByName(records).repartitionById(len(starts) + 1, F.col("shard").cast("int"))
    sorted_rows = rows.sortWithinPartitions(*order)
    written = stage(sorted_rows.mapInArrow(_shard_writer(folder, file_bytes), f"{MANIFEST}, temporary string"), "warc-written")
    manifest = f"{folder}/manifest"
    written.repartition("name").mapInArrow(_renamer(folder), MANIFEST).write.parquet(manifest)
    system, root = fs.FileSystem.from_uri(folder)
    if system.get_file_info(f"{root}/temporary").type == fs.FileType.Directory:
        system.delete_dir(f"{root}/temporary")  # only files of attempts that do not count are left
    return Archive(f"{folder}/files", manifest)


# -- reading --------------------------------------------------------------------------------


RECORD = (
    "page_id long, url string, record_id string, record_type string, payload_bytes long, payload_digest string, "
    "refers_to long"
)


def _reader(payloads: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                path = batch.column("path")[i].as_py()
                name, rows, held = path.rsplit("/", 1)[-1], [], 0
                for data in members(batch.column("content")[i].as_py()):
                    rows.append({"name": name, **parse(data)})
                    held += len(data) if payloads else 0
                    if held > 16 << 20:
                        yield _record_rows(rows, payloads)
                        rows, held = [], 0
                if rows:
                    yield _record_rows(rows, payloads)

    return run


def _record_rows(rows: list[dict], payloads: bool) -> pa.RecordBatch:
    kinds = {
        "name": pa.string(), "page_id": pa.int64(), "url": pa.string(), "record_id": pa.string(), "record_type": pa.string(),
        "payload_bytes": pa.int64(), "payload_digest": pa.string(), "refers_to": pa.int64(), "payload": pa.binary(),
    }
    if not payloads:
        del kinds["payload"]
    return pa.record_batch([pa.array([r[n] for r in rows], kind) for n, kind in kinds.items()], names=list(kinds))


def read(spark: SparkSession, archive: Archive, payloads: bool = False) -> DataFrame:
    """One row per record, every digest checked, and the counts of the manifest.

    With ``payloads`` the payload of responses follows as a column.
    """
    manifest = spark.read.schema(MANIFEST).parquet(archive.manifest)
    schema = f"name string, {RECORD}" + (", payload binary" if payloads else "")
    if manifest.isEmpty():
        return spark.createDataFrame([], schema).drop("name")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(archive.files)
    rows = stage(files.select("path", "content").mapInArrow(_reader(payloads), schema), "warc-records")
    counts = rows.groupBy("name").agg(F.count("*").alias("found"))
    wrong = counts.join(manifest, "name", "full").where("NOT found <=> records").select("name", "records", "found").first()
    if wrong:
        raise ValueError(f"archive and manifest differ: {wrong}")
    return rows.drop("name")
